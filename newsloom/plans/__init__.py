"""Queries over the driver's tables, with their SQL."""

from newsloom.plans import documents, events, queue  # noqa: F401
from newsloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
