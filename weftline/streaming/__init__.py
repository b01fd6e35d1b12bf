"""Streaming forms of the operators that carry state between runs."""
