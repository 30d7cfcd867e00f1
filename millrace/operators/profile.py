"""Statistical profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import normalise
from ..functions.dates import is_date_part
from .facts import Facts

QUARTILES = [0.25, 0.5, 0.75]
# Names of the numeric statistics, in report order.
STATISTICS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max", "skewness", "kurtosis"]


def missing(facts: Facts) -> dict[str, dict]:
    rows = facts.rows
    return {c: {"count": n, "pct": round(100 * n / rows, 2)} for c, n in facts.nulls().items() if n}


def summary_columns(facts: Facts, min_rows: int = 11, hide_date_parts: bool = True) -> list[str]:
    """Numeric columns that are neither 0/1 indicators, nor identifier-like, nor named as a date part."""
    scan = facts.scan()
    plain = [
        c
        for c in facts.columns("numeric")
        if not scan[c].binary and not (hide_date_parts and is_date_part(c))
    ]
    unique = facts.mostly_unique(plain, 0.95, min_rows)
    return [c for c in plain if not unique[c]]


def numeric_statistics(facts: Facts, columns: list[str]) -> dict[str, dict[str, float | None]]:
    """Unrounded statistics per column, under the names of STATISTICS."""
    scan, std, quartiles = facts.scan(), facts.std(columns), facts.quantiles(columns, QUARTILES)
    out = {}
    for c in columns:
        values = [
            float(scan[c].present),
            scan[c].mean,
            std[c],
            None if scan[c].lo is None else float(scan[c].lo),
            *quartiles[c],
            None if scan[c].hi is None else float(scan[c].hi),
            facts.skewness(c),
            facts.kurtosis(c),
        ]
        out[c] = dict(zip(STATISTICS, values))
    return out


def numerical(facts: Facts, hide_date_parts: bool = True) -> dict[str, dict]:
    stats = numeric_statistics(facts, summary_columns(facts, hide_date_parts=hide_date_parts))
    return {c: {k: None if v is None else round(v, 4) for k, v in s.items()} for c, s in stats.items()}


def categorical(facts: Facts) -> dict[str, dict]:
    columns, nulls = facts.columns("categorical"), facts.nulls()
    return {
        c: {"n_unique": v.n_unique, "top_5": dict(v.top[:5]), "missing": nulls[c]}
        for c, v in facts.levels(columns).items()
    }


def temporal(facts: Facts) -> dict[str, dict]:
    scan, nulls = facts.scan(), facts.nulls()
    out = {}
    for c in facts.columns("temporal"):
        lo, hi = scan[c].lo, scan[c].hi
        out[c] = {
            "min": "NaT" if lo is None else str(lo),
            "max": "NaT" if hi is None else str(hi),
            "range_days": None if lo is None else (hi - lo).days,
            "missing": nulls[c],
        }
    return out


def profile(df: DataFrame, facts: Facts | None = None, hide_date_parts: bool = True) -> dict:
    """Shape, types, missing values and per-role summaries as a nested dict of size O(columns)."""
    df = df if facts else normalise(df)
    facts = facts or Facts(df)
    return {
        "shape": {"rows": facts.rows, "cols": len(facts.roles)},
        "dtypes": {c: t for c, t in df.dtypes if c in facts.roles},
        "missing": missing(facts),
        "numerical": numerical(facts, hide_date_parts),
        "categorical": categorical(facts),
        "temporal": temporal(facts),
    }


def numeric_table(spark: SparkSession, stats: dict[str, dict]) -> DataFrame:
    """The numeric summary as a tall DataFrame, one row per column."""
    schema = "column string, " + ", ".join(f"`{s}` double" for s in STATISTICS)
    return spark.createDataFrame([(c, *[s[k] for k in STATISTICS]) for c, s in stats.items()], schema)
