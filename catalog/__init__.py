"""Registered queries: a Spark callable and, where SQL can state it, the same result in SQL."""

from . import charts, cleaning, encoding, features, profiling, runs, sources  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
