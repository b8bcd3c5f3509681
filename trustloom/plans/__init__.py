"""Named queries over the shared tables, each with the SQL that states the same result."""

from trustloom.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
