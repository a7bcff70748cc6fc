"""Importing this module registers every query."""

from tidemark.catalog import analysis, geo, models, tables  # noqa: F401
from tidemark.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
