"""Readers: semi-structured payloads, tables in HTML, Markdown, snapshots."""
