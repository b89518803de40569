"""Operators of a training-data pipeline over documents and pages; nothing else in the library imports this subpackage."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
