"""Missing values: counts, column drops and fill strategies."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import POSITION, data_columns, ref, replace_columns, roles
from ..functions.dates import from_micros, micros
from .counts import top_of_counts, value_counts
from .facts import Facts
from .measure import measure
from .ordered import ordered_fill
from .quantiles import exact_quantiles

# Names of the strategies.
STRATEGIES = ("auto", "drop", "mean", "median", "mode", "ffill", "bfill", "constant")


def null_counts(df: DataFrame) -> dict[str, int]:
    """Nulls per column, only columns that have any."""
    got = measure(df, {c: F.count_if(ref(c).isNull()) for c in data_columns(df)})
    return {c: n for c, n in got.items() if n}


def missing_summary(df: DataFrame) -> DataFrame:
    """Tall (column, nulls, pct), lazily: one row per column that has nulls."""
    columns = data_columns(df)
    cells = [x for c in columns for x in (F.lit(c), F.col(f"n{columns.index(c)}"))]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(ref(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    )
    return (
        counts.select("rows", F.stack(F.lit(len(columns)), *cells).alias("column", "nulls"))
        .where(F.col("nulls") > 0)
        .select("column", "nulls", (F.col("nulls") * 100.0 / F.col("rows")).alias("pct"))
    )


def high_missing_columns(facts: Facts, threshold: float = 0.5) -> list[str]:
    """Columns whose share of nulls is above ``threshold``."""
    if not facts.rows:
        return []
    return [c for c, n in facts.nulls().items() if n / facts.rows > threshold]


def sequential_drop_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Nulls per column among rows without a null in any earlier column, in one scan."""
    exprs: dict[str, Column] = {}
    earlier = F.lit(True)
    for c in columns:
        exprs[c] = F.count_if(earlier & ref(c).isNull())
        earlier = earlier & ref(c).isNotNull()
    return {c: n for c, n in measure(df, exprs).items() if n} if exprs else {}


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    for c in data_columns(df) if columns is None else columns:
        keep = keep & ref(c).isNotNull()
    return df.where(keep)


def _time_literal(micro: float | int | None) -> Column:
    return from_micros(F.lit(None if micro is None else int(micro)))


def mean_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    kinds = roles(df)
    got = measure(
        df, {c: F.avg(micros(ref(c)) if kinds[c] == "temporal" else ref(c).cast("double")) for c in columns}
    )
    return {c: _time_literal(v) if kinds[c] == "temporal" else F.lit(v).cast("double") for c, v in got.items()}


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    kinds = roles(df)
    timed = [c for c in columns if kinds[c] == "temporal"]
    # Microseconds of any date up to the year 2255 are exact as doubles.
    numbers = replace_columns(df, {c: micros(ref(c)) for c in timed})
    got = exact_quantiles(numbers, columns, [0.5])
    return {c: _time_literal(v) if c in timed else F.lit(v).cast("double") for c, (v,) in got.items()}


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Most frequent value; of equally frequent ones the smallest in the column's own order."""
    out: dict[str, Column] = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for dtype, members in by_type.items():
        tops = top_of_counts(value_counts(df, members, dtype), 1)
        # Text form of one value per column; every type here reads back exactly.
        rows = {r["column"]: r["text"] for r in tops.select("column", F.col("value").cast("string").alias("text")).collect()}
        out.update({c: F.lit(rows.get(c)).cast(dtype) for c in members})
    return out


def _filled(df: DataFrame, values: dict[str, Column], widen: bool) -> DataFrame:
    """Coalesce with one literal per column; whole numbers become double when ``widen``."""
    kinds = roles(df)
    new = {}
    for c, value in values.items():
        base = ref(c).cast("double") if widen and kinds[c] == "numeric" else ref(c)
        new[c] = F.coalesce(base, value)
    return replace_columns(df, new)


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    check_fillable(df, columns, "mean")
    return _filled(df, mean_values(df, columns), widen=True)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    check_fillable(df, columns, "median")
    return _filled(df, median_values(df, columns), widen=True)


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _filled(df, mode_values(df, columns), widen=False)


def fill_constant(df: DataFrame, columns: Sequence[str], value: Any) -> DataFrame:
    """Fill with ``value``; it must fit the type of every column."""
    if value is None:
        raise ValueError("strategy 'constant' needs a fill value")
    check_constant(df, columns, value)
    whole = isinstance(value, (int, bool)) or not isinstance(value, float) or value.is_integer()
    new = {}
    for c in columns:
        t = df.schema[c].dataType
        if roles(df)[c] == "numeric" and not whole:
            new[c] = F.coalesce(ref(c).cast("double"), F.lit(float(value)))
        elif isinstance(t, T.TimestampNTZType):
            new[c] = F.coalesce(ref(c), F.lit(str(value)).cast(t))
        else:
            new[c] = F.coalesce(ref(c), F.lit(value).cast(t))
    return replace_columns(df, new)


def check_constant(df: DataFrame, columns: Sequence[str], value: Any) -> None:
    kinds = roles(df)

    def fits(c: str) -> bool:
        if isinstance(value, bool):
            return isinstance(df.schema[c].dataType, T.BooleanType)
        if isinstance(value, (int, float)):
            return kinds[c] == "numeric"
        return kinds[c] in ("categorical", "temporal")

    bad = [c for c in columns if not fits(c)]
    if bad:
        raise ValueError(f"fill value {value!r} does not fit the type of column(s) {bad}")


def check_fillable(df: DataFrame, columns: Sequence[str], strategy: str) -> None:
    kinds = roles(df)
    bad = [c for c in columns if kinds[c] not in ("numeric", "temporal")]
    if bad:
        raise ValueError(f"strategy {strategy!r} needs numeric or temporal columns, not {bad}")


def strategy_for(kind: str, strategy: str = "auto") -> str:
    """An explicit strategy holds for every column; ``auto`` goes by role."""
    if strategy != "auto":
        return strategy
    return {"numeric": "median", "temporal": "ffill"}.get(kind, "mode")


def fill_missing(
    df: DataFrame,
    strategy: str = "auto",
    fill_value: Any = None,
    order_by: Sequence[str] | None = None,
    facts: Facts | None = None,
) -> tuple[DataFrame, dict[str, int], Facts]:
    """Fill every column that has nulls; returns (df, {column: nulls filled}, facts of the result)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown missing strategy {strategy!r}; one of {STRATEGIES}")
    facts = facts or Facts(df)
    report = {c: n for c, n in facts.nulls().items() if n}
    if not report:
        return df, {}, facts
    holders = list(report)
    if strategy == "drop":
        report = sequential_drop_counts(df, holders)
        out = drop_null_rows(df, holders)
        return out, report, Facts(out)

    chosen: dict[str, list[str]] = {}
    for c in holders:
        chosen.setdefault(strategy_for(facts.roles[c], strategy), []).append(c)
    out = df
    for name, columns in chosen.items():
        if name in ("mean", "median"):
            check_fillable(df, columns, name)
        elif name == "constant":
            out = fill_constant(out, columns, fill_value)

    literals: dict[str, Column] = {}
    wide: dict[str, Column] = {}
    if "mean" in chosen:
        wide.update(mean_values(df, chosen["mean"]))
    if "median" in chosen:
        numbers = [c for c in chosen["median"] if facts.roles[c] == "numeric"]
        wide.update({c: F.lit(v).cast("double") for c, (v,) in facts.quantiles(numbers, [0.5]).items()})
        rest = [c for c in chosen["median"] if c not in numbers]
        wide.update(median_values(df, rest) if rest else {})
    if "mode" in chosen:
        text = [c for c in chosen["mode"] if facts.roles[c] == "categorical"]
        for c, v in facts.levels(text).items():
            literals[c] = F.lit(v.top[0][0] if v.top else None).cast("string")
        rest = [c for c in chosen["mode"] if c not in text]
        literals.update(mode_values(df, rest) if rest else {})
    out = _filled(_filled(out, wide, widen=True), literals, widen=False)

    ordered = False
    for name, direction in (("ffill", "forward"), ("bfill", "backward")):
        if name in chosen:
            out = ordered_fill(out, chosen[name], _order_of(out, chosen[name], order_by), direction, facts.rows)
            ordered = True
    facts = facts.derive(out, changed=holders)
    if ordered:
        # the sort runs once, not in every later job that touches a filled column
        facts = facts.stored("filled")
    return facts.df, report, facts


def check_order(df: DataFrame, facts: Facts, strategy: str, threshold: float, order_by: Sequence[str] | None) -> None:
    """Raise now what an ordered fill would raise after the profile: it needs an order of the rows.

    Columns that will be dropped for their share of nulls do not count.
    """
    if order_by or POSITION in df.columns or not facts.rows:
        return
    nulls = facts.nulls()
    kept = [c for c, r in facts.roles.items() if 0 < nulls[c] <= threshold * facts.rows and strategy_for(r, strategy) in ("ffill", "bfill")]
    if kept:
        _order_of(df, kept, order_by)


def _order_of(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None) -> list[str]:
    if order_by:
        return list(order_by)
    if POSITION in df.columns:
        return [POSITION]
    raise ValueError(
        f"filling {list(columns)} in order needs order_by=[...], or a table loaded with keep_position=True"
    )
