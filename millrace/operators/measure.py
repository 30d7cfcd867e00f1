"""One-row statistics: many aggregate expressions in as few scans as possible."""

from __future__ import annotations

from collections.abc import Hashable
from typing import Any

from pyspark.sql import Column, DataFrame

# Beyond this many expressions generated aggregate code outgrows the JVM method limit.
EXPRESSIONS_PER_SCAN = 300


def measure(df: DataFrame, exprs: dict[Hashable, Column]) -> dict[Hashable, Any]:
    """Evaluate aggregate ``exprs`` over ``df``; the result is one value per key."""
    items = list(exprs.items())
    out: dict[Hashable, Any] = {}
    for start in range(0, len(items), EXPRESSIONS_PER_SCAN):
        chunk = items[start : start + EXPRESSIONS_PER_SCAN]
        row = df.agg(*[e.alias(f"m{i}") for i, (_, e) in enumerate(chunk)]).first()
        out.update({key: row[i] for i, (key, _) in enumerate(chunk)})
    return out
