"""Catalogue integration as Spark DataFrame jobs."""
