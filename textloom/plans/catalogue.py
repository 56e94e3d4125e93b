"""Every query of the core, with the SQL that checks it."""

from textloom.plans import search_queries, sequence_queries, suffix_queries, table_queries  # noqa: F401
from textloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
