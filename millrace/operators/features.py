"""Date features and the removal of uninformative columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import columns_of, ref
from ..functions.dates import date_parts
from .facts import Facts


def extract_date_features(df: DataFrame, drop_source: bool = True, facts: Facts | None = None) -> tuple[DataFrame, list[str], Facts]:
    """Append date parts of every temporal column; the hour only where more than one occurs.

    Returns (df, names of the new columns, facts).
    """
    facts = facts or Facts(df)
    dates = columns_of(df, "temporal")
    if not dates:
        return df, [], facts
    scan = facts.scan()
    new: dict = {}
    listed: list[str] = []
    for c in dates:
        parts = {c + suffix: e for suffix, e in date_parts(ref(c)).items()}
        first, last = scan[c].hours
        if first != last:
            parts[f"{c}_hour"] = F.hour(ref(c))
            listed.append(f"{c}_hour")
        listed += [n for n in parts if n != f"{c}_hour"]
        new.update(parts)
    # a column that already has the name of a part (names ignore case) gives way to it, in its place
    taken = {c.lower(): c for c in df.columns}
    held = {taken[n.lower()]: n for n in new if n.lower() in taken}
    kept = [
        new[held[c]].alias(held[c]) if c in held else ref(c) for c in df.columns if c in held or not (drop_source and c in dates)
    ]
    out = df.select(*kept, *[e.alias(n) for n, e in new.items() if n not in held.values()])
    return out, listed, facts.derive(out, changed=new)


def identifier_columns(facts: Facts, threshold: float = 0.95) -> list[str]:
    """Text and numeric columns in which nearly every row has its own value; none in tables up to ten rows."""
    verdict = facts.mostly_unique(facts.columns("categorical", "numeric"), threshold, min_rows=11)
    return [c for c, unique in verdict.items() if unique]


def low_variance_columns(facts: Facts, threshold: float = 0.01, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose sample standard deviation is under ``threshold``; undefined ones stay."""
    columns = facts.columns("numeric") if columns is None else list(columns)
    return [c for c, s in facts.std(columns).items() if s is not None and s < threshold]


def correlated_columns(facts: Facts, threshold: float = 0.95, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with |r| above ``threshold`` to any earlier one, whether or not that one is dropped too."""
    columns = facts.columns("numeric") if columns is None else list(columns)
    if len(columns) < 2:
        return []
    high = {b for (_, b), r in facts.pearson(columns).items() if r is not None and abs(r) > threshold}
    return [c for c in columns if c in high]
