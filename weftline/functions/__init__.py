"""Column expressions. Everything here stays JVM-side; no Python runs per row."""
