"""Type inference for text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import columns_of, ref, replace_columns
from ..functions.parsing import is_integer_text, to_boolean, to_number, to_timestamp
from .counts import Levels
from .facts import Facts
from .measure import measure

SHARE_NEEDED = 0.8


def parse_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, dict[str, int]]]:
    """Rows, and per text column how many values read as number, whole number, timestamp."""
    exprs: dict = {"rows": F.count(F.lit(1))}
    for c in columns:
        v = ref(c)
        exprs[c, "number"] = F.count(to_number(v))
        exprs[c, "integer"] = F.count_if(is_integer_text(v))
        exprs[c, "timestamp"] = F.count(to_timestamp(v))
    got = measure(df, exprs)
    return got["rows"], {c: {k: got[c, k] for k in ("number", "integer", "timestamp")} for c in columns}


def _parse_counts_of_levels(df: DataFrame, known: dict[str, Levels]) -> dict[str, dict[str, int]]:
    """The same from complete value lists: each value is read once, weighted by its count."""
    rows = [(c, v, n) for c, level in known.items() for v, n in level.top]
    v, n = F.col("value"), F.col("n")

    def total(hit: Column) -> Column:
        return F.sum(F.when(hit, n).otherwise(0))

    got = (
        df.sparkSession.createDataFrame(rows, "column string, value string, n bigint")
        .groupBy("column")
        .agg(
            total(to_number(v).isNotNull()).alias("number"),
            total(is_integer_text(v)).alias("integer"),
            total(to_timestamp(v).isNotNull()).alias("timestamp"),
        )
        .collect()
    )
    out = {r["column"]: {k: r[k] for k in ("number", "integer", "timestamp")} for r in got}
    return {c: out.get(c, {"number": 0, "integer": 0, "timestamp": 0}) for c in known}


def _may_parse(text: str) -> bool:
    return "inf" in text.lower() or any(ch.isdecimal() for ch in text)


def infer_types(
    df: DataFrame,
    share: float = SHARE_NEEDED,
    columns: Sequence[str] | None = None,
    facts: Facts | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Convert a text column when more than ``share`` of all rows parse; the rest become null.

    Numbers are tried first. Returns the DataFrame and {column: new type}.
    ``facts`` of ``df`` that list all values of a column spare it the scan.
    """
    columns = columns_of(df, "categorical") if columns is None else list(columns)
    if not columns:
        return df, {}
    known = {c: v for c, v in facts.known_levels().items() if c in columns and v.complete} if facts else {}
    # A column without a digit in any of its values can hold infinities, but no other number and no date.
    candidates = {c: v for c, v in known.items() if any(_may_parse(text) for text, _ in v.top)}
    counts = {c: {"number": 0, "integer": 0, "timestamp": 0} for c in known}
    if candidates:
        counts.update(_parse_counts_of_levels(df, candidates))
    scanned = [c for c in columns if c not in known]
    if scanned:
        rows, more = parse_counts(df, scanned)
        counts.update(more)
    else:
        rows = facts.rows
    new: dict[str, Column] = {}
    made: dict[str, str] = {}
    for c in columns:
        n = counts[c]
        if n["number"] / max(rows, 1) > share:
            whole = n["integer"] == n["number"]
            new[c] = F.trim(ref(c)).try_cast("bigint") if whole else to_number(ref(c))
            made[c] = "bigint" if whole else "double"
        elif n["timestamp"] / max(rows, 1) > share:
            new[c], made[c] = to_timestamp(ref(c)), "timestamp_ntz"
    return replace_columns(df, new), made


def infer_scan_types(df: DataFrame, extra: dict | None = None) -> tuple[DataFrame, dict]:
    """Reader-side inference: a type is taken only if every non-null text fits it.

    ``extra`` aggregate expressions ride along in the same scan; their values are returned.
    """
    columns = columns_of(df, "categorical")
    exprs: dict = dict(extra or {})
    for c in columns:
        v = ref(c)
        exprs[c, "present"] = F.count(v)
        exprs[c, "integer"] = F.count_if(is_integer_text(v))
        exprs[c, "number"] = F.count(to_number(v))
        exprs[c, "boolean"] = F.count(to_boolean(v))
    exprs["__rows"] = F.count(F.lit(1))
    got = measure(df, exprs)
    new: dict[str, Column] = {}
    for c in columns:
        present = got[c, "present"]
        if not got["__rows"]:
            continue
        if present and got[c, "integer"] == present:
            new[c] = F.trim(ref(c)).cast("bigint")
        elif got[c, "number"] == present:  # also a column without any value
            new[c] = to_number(ref(c))
        elif got[c, "boolean"] == present:
            new[c] = to_boolean(ref(c))
    return replace_columns(df, new), {k: got[k] for k in (extra or {})}
