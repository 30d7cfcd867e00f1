"""Pairwise-complete Pearson correlation from sums around known means."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref
from .measure import measure

# Up to this many pairs the sums are plain aggregate expressions; beyond, per-partition matrices.
EXPRESSION_PAIRS = 66
# Tasks that fold rows into matrices, and tasks that merge those.
MATRIX_TASKS = 4096
MERGE_TASKS = 8
_FIELDS = ("n", "x", "y", "xx", "yy", "xy")


class Sums(NamedTuple):
    """Over the rows where both are present: count, sums, squares and product of the distances."""

    n: float
    x: float
    y: float
    xx: float
    yy: float
    xy: float


def pearson(s: Sums) -> float | None:
    if not s.n:
        return None
    vx, vy = s.xx - s.x * s.x / s.n, s.yy - s.y * s.y / s.n
    if not (vx > 0 and vy > 0) or _vanishes(vx, s.xx) or _vanishes(vy, s.yy):
        return None
    r = (s.xy - s.x * s.y / s.n) / math.sqrt(vx * vy)
    return max(-1.0, min(1.0, r))


def _vanishes(variance: float, squares: float) -> bool:
    """A constant column leaves only rounding noise of its squares."""
    return variance <= squares * 1e-13


def centred_sums(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    means: dict[str, float | None],
    with_nulls: set[str],
    rows: int,
    expression_pairs: int = EXPRESSION_PAIRS,
) -> dict[tuple[str, str], Sums]:
    empty = [p for p in pairs if means[p[0]] is None or means[p[1]] is None]
    live = [p for p in pairs if p not in set(empty)]
    out = {p: Sums(0, 0.0, 0.0, 0.0, 0.0, 0.0) for p in empty}
    if live:
        by = _by_expressions if len(live) <= expression_pairs else _by_matrices
        out.update(by(df, live, means, with_nulls, rows))
    return out


def _by_expressions(df, pairs, means, with_nulls, rows) -> dict[tuple[str, str], Sums]:
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    d = {c: ref(c).cast("double") - F.lit(means[c]) for c in columns}
    exprs: dict = {}
    for c in columns:
        exprs[c, "s"], exprs[c, "ss"] = F.sum(d[c]), F.sum(d[c] * d[c])
    masked = [p for p in pairs if p[0] in with_nulls or p[1] in with_nulls]
    for a, b in pairs:
        exprs[a, b, "xy"] = F.sum(d[a] * d[b])
    for a, b in masked:
        both = ref(a).isNotNull() & ref(b).isNotNull()
        exprs[a, b, "n"] = F.count_if(both)
        exprs[a, b, "x"], exprs[a, b, "y"] = F.sum(F.when(both, d[a])), F.sum(F.when(both, d[b]))
        exprs[a, b, "xx"], exprs[a, b, "yy"] = F.sum(F.when(both, d[a] * d[a])), F.sum(F.when(both, d[b] * d[b]))
    got = measure(df, exprs)
    out = {}
    for a, b in pairs:
        if (a, b, "n") in got:
            out[a, b] = Sums(*[got[a, b, f] or 0.0 for f in _FIELDS])
        else:
            out[a, b] = Sums(rows, got[a, "s"], got[b, "s"], got[a, "ss"], got[b, "ss"], got[a, b, "xy"])
    return out


def _by_matrices(df, pairs, means, with_nulls, rows) -> dict[tuple[str, str], Sums]:
    """Many columns: each partition folds its Arrow batches into k x k matrices."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    centre = np.array([means[c] for c in columns])
    k = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_FIELDS), k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            mask = ~np.isnan(x)
            d = np.where(mask, x - centre, 0.0)
            m = mask.astype(float)
            sq = d * d
            total += np.stack([m.T @ m, d.T @ m, m.T @ d, sq.T @ m, m.T @ sq, d.T @ d])
        yield packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_FIELDS), k, k))
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_py()).reshape(total.shape)
        yield packed(total)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    # one row of matrices per task, of which there are at most MATRIX_TASKS, merged in two levels
    numbers = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).coalesce(MATRIX_TASKS)
    folded = numbers.mapInArrow(fold, "sums binary").repartition(MERGE_TASKS).mapInArrow(merge, "sums binary")
    total = np.zeros((len(_FIELDS), k, k))
    for row in folded.collect():  # MERGE_TASKS rows
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    place = {c: i for i, c in enumerate(columns)}
    return {(a, b): Sums(*total[:, place[a], place[b]].tolist()) for a, b in pairs}
