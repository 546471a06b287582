"""Registered queries with their DuckDB statements; every query reads the given tables in full."""

from catalog.base import ORACLES, QUERIES
from catalog import features, learning, tables  # noqa: F401  (registration)

__all__ = ["QUERIES", "ORACLES"]
