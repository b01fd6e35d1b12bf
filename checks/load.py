"""Imports every query module so that the registry is complete."""

from checks import q_functions, q_guards, q_merge, q_rollups, q_search, q_sources, q_state  # noqa: F401
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
