"""All registered queries."""

from . import analysis_queries, batch_queries, planning_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
