"""The data behind exploratory charts, as small or bounded DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import columns_of, normalise, ref
from ..functions.dates import from_micros, micros
from .counts import top_values
from .facts import Facts
from .measure import measure
from .missing import missing_summary
from .profile import summary_columns

BINS = 30
TOP = 15
SERIES_COLUMNS = 5


def chart_columns(facts: Facts) -> list[str]:
    """Numeric columns worth drawing: no indicators, no identifiers (in tables of any size)."""
    return summary_columns(facts, min_rows=1, hide_date_parts=False)


def missing_chart(df: DataFrame) -> DataFrame:
    """(column, pct), largest share first."""
    return missing_summary(df).select("column", "pct").orderBy(F.desc("pct"), "column")


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS, facts: Facts | None = None) -> DataFrame:
    """(column, bin, n) over equal-width bins from minimum to maximum, the last one closed."""
    facts = facts or Facts(df)
    columns = chart_columns(facts) if columns is None else list(columns)
    scan, cells = facts.scan(), []
    live = [c for c in columns if scan[c].present]
    for c in live:
        lo, hi = float(scan[c].lo), float(scan[c].hi)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        at = F.floor((ref(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) * bins)
        # least skips nulls, so a missing value is kept out explicitly.
        cells += [F.lit(c), F.when(at.isNotNull(), F.least(at, F.lit(bins - 1).cast("bigint"))).cast("int")]
    if not live:
        return df.sparkSession.createDataFrame([], "column string, bin int, n bigint")
    return (
        df.select(F.stack(F.lit(len(live)), *cells).alias("column", "bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_statistics(df: DataFrame, columns: Sequence[str] | None = None, facts: Facts | None = None) -> DataFrame:
    """(column, q1, median, q3, whisker_low, whisker_high, n_fliers) with whiskers at the last value within 1.5 IQR."""
    facts = facts or Facts(df)
    columns = chart_columns(facts) if columns is None else list(columns)
    quartiles = {c: q for c, q in facts.quantiles(columns, [0.25, 0.5, 0.75]).items() if q[0] is not None}
    exprs = {}
    for c, (q1, _, q3) in quartiles.items():
        v, reach = ref(c).cast("double"), 1.5 * (q3 - q1)
        near = v.between(F.lit(q1 - reach), F.lit(q3 + reach))
        exprs[c, "low"], exprs[c, "high"] = F.min(F.when(near, v)), F.max(F.when(near, v))
        exprs[c, "fliers"] = F.count_if(~near)
    got = measure(df, exprs) if exprs else {}
    rows = []
    for c, (q1, median, q3) in quartiles.items():
        # The whiskers never end inside the box.
        rows.append((c, q1, median, q3, min(got[c, "low"], q1), max(got[c, "high"], q3), got[c, "fliers"]))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, n_fliers bigint",
    )


def top_chart(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP) -> DataFrame:
    """(column, value, n, rank) of the most frequent values."""
    columns = columns_of(df, "categorical") if columns is None else list(columns)
    return top_values(df, columns, k)


def time_series(df: DataFrame, time_column: str, columns: Sequence[str], max_points: int | None = None, facts: Facts | None = None) -> DataFrame:
    """The columns in time order; with ``max_points``, averages over that many equal time slices."""
    t = ref(time_column)
    if max_points is None:
        # The row number beside the time lets the range exchange split a moment that many rows share.
        chosen = df.select(t, *[ref(c) for c in columns], F.monotonically_increasing_id().alias("__row"))
        return chosen.orderBy(t, "__row").drop("__row")
    facts = facts or Facts(df)
    lo, hi = facts.scan()[time_column].lo, facts.scan()[time_column].hi
    if lo is None:
        return df.select(t, *[ref(c).cast("double").alias(c) for c in columns]).limit(0)
    wide = max(int((hi - lo).total_seconds() * 1e6) // max_points + 1, 1)
    since = micros(t.cast("timestamp_ntz")) - micros(F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz"))
    slot = from_micros(micros(F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz")) + F.floor(since / wide) * wide)
    return (
        df.where(t.isNotNull())
        .groupBy(slot.alias(time_column))
        .agg(*[F.avg(ref(c)).alias(c) for c in columns])
        .orderBy(ref(time_column))
    )


def monthly_mean(df: DataFrame, time_column: str, columns: Sequence[str]) -> DataFrame:
    """(month, mean of every column) for the months that occur."""
    month = F.date_trunc("MONTH", ref(time_column)).cast("timestamp_ntz")
    return (
        df.where(ref(time_column).isNotNull())
        .groupBy(month.alias("month"))
        .agg(*[F.avg(ref(c)).alias(c) for c in columns])
        .orderBy("month")
    )


def correlation_table(facts: Facts, columns: Sequence[str] | None = None) -> DataFrame:
    """Tall (column_a, column_b, r): the upper triangle over all numeric columns."""
    columns = facts.columns("numeric") if columns is None else list(columns)
    rows = [(a, b, r) for (a, b), r in facts.pearson(columns).items()] if len(columns) > 1 else []
    return facts.df.sparkSession.createDataFrame(rows, "column_a string, column_b string, r double")


def chart_data(df: DataFrame, facts: Facts | None = None, max_points: int | None = None) -> dict[str, DataFrame]:
    """Chart name -> DataFrame, for every chart the table gives rise to; series hold every row unless ``max_points`` is set."""
    df = df if facts else normalise(df)
    facts = facts or Facts(df)
    charts: dict[str, DataFrame] = {}
    nulls = {c: n for c, n in facts.nulls().items() if n}
    if nulls:
        rows = sorted(((c, 100.0 * n / facts.rows) for c, n in nulls.items()), key=lambda r: (-r[1], r[0]))
        charts["missing"] = df.sparkSession.createDataFrame(rows, "column string, pct double")
    numeric = chart_columns(facts)
    if numeric:
        charts["histogram"] = histogram(df, numeric, facts=facts)
        charts["box"] = box_statistics(df, numeric, facts)
    text = facts.columns("categorical")
    if text:
        rows = [
            (c, v, n, i) for c, known in facts.levels(text, TOP).items() for i, (v, n) in enumerate(known.top[:TOP], 1)
        ]
        charts["top"] = df.sparkSession.createDataFrame(rows, "column string, value string, n bigint, rank int")
    for t in facts.columns("temporal"):
        if numeric:
            charts[f"series:{t}"] = time_series(df, t, numeric[:SERIES_COLUMNS], max_points, facts)
            if facts.rows > 10:
                charts[f"monthly:{t}"] = monthly_mean(df, t, numeric[:SERIES_COLUMNS])
    if len(facts.columns("numeric")) >= 2:
        charts["correlation"] = correlation_table(facts)
    return charts
