"""Outlier bounds, clipping and removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import columns_of, ref, replace_columns
from .facts import Facts
from .measure import measure

# Columns whose rows are removed one after the other are judged so many at a time.
LOOK_AHEAD = 4
METHODS = ("iqr", "zscore", "none")
ACTIONS = ("clip", "remove", "none")
MIN_VALUES = 4

Bounds = dict[str, tuple[float, float]]


def iqr_bounds(facts: Facts, columns: Sequence[str], multiplier: float = 1.5) -> Bounds:
    quartiles = facts.quantiles(columns, [0.25, 0.75])
    out = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is not None:
            reach = multiplier * (q3 - q1)
            out[c] = (q1 - reach, q3 + reach)
    return out


def zscore_bounds(facts: Facts, columns: Sequence[str], threshold: float = 3.0) -> Bounds:
    """Smallest and largest value whose distance from the mean is under ``threshold`` population deviations."""
    scan, std = facts.scan(), facts.std(columns, ddof=0)
    exprs = {}
    for c in columns:
        if std[c]:  # a constant column has no z-score
            v = ref(c).cast("double")
            near = F.when(F.abs((v - F.lit(scan[c].mean)) / F.lit(std[c])) < threshold, v)
            exprs[c, 0], exprs[c, 1] = F.min(near), F.max(near)
    if not exprs:
        return {}
    got = measure(facts.df, exprs)
    return {c: (got[c, 0], got[c, 1]) for c in columns if std[c] and got[c, 0] is not None}


def outlier_bounds(
    facts: Facts, columns: Sequence[str], method: str = "iqr", multiplier: float = 1.5, threshold: float = 3.0
) -> Bounds:
    """Bounds of the columns with at least four values."""
    scan = facts.scan()
    live = [c for c in columns if scan[c].present >= MIN_VALUES]
    return iqr_bounds(facts, live, multiplier) if method == "iqr" else zscore_bounds(facts, live, threshold)


def outlier_counts(facts: Facts, bounds: Bounds) -> dict[str, int]:
    """Values outside the bounds, only columns that have any; known extremes spare the scan of the others."""
    scan = facts.scan()
    exprs = {
        c: F.count_if((ref(c) < F.lit(lo)) | (ref(c) > F.lit(hi)))
        for c, (lo, hi) in bounds.items()
        if scan[c].lo < lo or scan[c].hi > hi
    }
    return {c: n for c, n in measure(facts.df, exprs).items() if n} if exprs else {}


def clip(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Clamp to the bounds as double; nulls stay null (least and greatest alone would skip them)."""
    new = {}
    for c, (lo, hi) in bounds.items():
        v = ref(c).cast("double")
        new[c] = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(float(hi))), F.lit(float(lo))))
    return replace_columns(df, new)


def handle_outliers(
    df: DataFrame,
    method: str = "iqr",
    action: str = "clip",
    multiplier: float = 1.5,
    threshold: float = 3.0,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    facts: Facts | None = None,
) -> tuple[DataFrame, dict[str, int] | None, Facts]:
    """Clip or remove outliers; the report is None when method or action is 'none'."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method!r}; one of {METHODS}")
    if action not in ACTIONS:
        raise ValueError(f"unknown outlier action {action!r}; one of {ACTIONS}")
    facts = facts or Facts(df)
    if method == "none" or action == "none":
        return df, None, facts
    columns = [c for c in (columns_of(df, "numeric") if columns is None else columns) if c not in exclude]
    if action == "clip":
        bounds = outlier_bounds(facts, columns, method, multiplier, threshold)
        report = outlier_counts(facts, bounds)
        out = clip(df, {c: bounds[c] for c in report})
        return out, report, facts.derive(out, changed=report)
    return _remove(facts, columns, method, multiplier, threshold)


def _remove(facts: Facts, columns: list[str], method: str, multiplier: float, threshold: float):
    """Column by column: the bounds of a column come from the rows the earlier ones left.

    LOOK_AHEAD columns are judged together; a column that removes rows starts a new
    round behind it, so the scans grow with the columns, not with their square. The
    result is a chain of literal filters on the source, so nothing has to be stored
    between rounds.
    """
    report: dict[str, int] = {}
    rest = list(columns)
    while rest:
        judged = rest[:LOOK_AHEAD]
        bounds = outlier_bounds(facts, judged, method, multiplier, threshold)
        counts = outlier_counts(facts, bounds)
        hit = next((c for c in judged if c in counts), None)
        if hit is None:
            rest = rest[LOOK_AHEAD:]
            continue
        lo, hi = bounds[hit]
        report[hit] = counts[hit]
        kept = facts.df.where(ref(hit).isNull() | ref(hit).between(F.lit(lo), F.lit(hi)))
        facts = Facts(kept)
        rest = rest[rest.index(hit) + 1 :]
    return facts.df, report, facts
