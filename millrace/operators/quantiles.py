"""Exact quantiles by counting digits, with bounded memory per task.

``percentile`` keeps every distinct value of a column in one aggregation buffer,
which a 100 TB column overflows. Here a double is read as a 64-bit key of the same
order, and the values between the ends of a column are counted by the leading digit of
their distance from the lower end (of their key, where ends are unknown or infinite or
one digit took most rows) in arrays of ``BINS`` counters: one pass over the rows for all
columns at once, no row is multiplied. The bin that holds a rank becomes the next
range; its rows are counted by the next digit, or, once few enough are left, read and
ranked outright. Bins carry their real ends, so a bin of one value needs no further
pass and gaps are skipped. Two passes serve a few million rows, one more each factor of a thousand;
integers within ``BINS`` values of known ends need one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ref
from .measure import measure

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 1024
# Values read outright in one pass, over all ranges; a task returns no more than it holds of them.
READ = 1 << 18
# Up to this many rows the built-in aggregate's buffer is small and one job suffices.
BUILT_IN_ROWS = 50_000
_LOW = (1 << 63) - 1


def keys_of(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys in the order of the doubles; NaN, of one kind, comes last."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(_LOW), bits)


def values_of(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.int64)
    return np.where(keys < 0, keys ^ np.int64(_LOW), keys).view(np.float64)


@dataclass
class _Range:
    """Rows of column number ``at`` with keys from lo to hi: ``inside`` of them, ``below`` sort before."""

    at: int
    lo: int
    hi: int
    below: int
    inside: int
    ranks: set[int]
    even: bool = True  # digits of the distance from lo, rather than of the key

    def __post_init__(self) -> None:
        lo, hi = values_of([self.lo, self.hi]).tolist()
        # the step must be a number: neither of infinite ends nor of ends closer than any step
        self.even = self.even and math.isfinite(hi - lo) and (hi == lo or hi - lo > 1e-300)

    def bins(self, keys: np.ndarray) -> np.ndarray:
        """Bin of each key, not descending; lo and hi never share one unless equal."""
        if self.even:
            lo, hi = values_of([self.lo, self.hi]).tolist()
            # integers that are no more than BINS have a bin each
            scale = 1.0 if hi - lo == BINS - 1 else (BINS - 1) / (hi - lo) if hi > lo else 0.0
            return ((values_of(keys) - lo) * scale).astype(np.int64)
        width = np.uint64((self.hi - self.lo) // BINS + 1)
        return ((keys.view(np.uint64) - np.array([self.lo], np.int64).view(np.uint64)) // width).astype(np.int64)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    counts: dict[str, int] | None = None,
    ends: dict[str, tuple[float, float]] | None = None,
    built_in_rows: int = BUILT_IN_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, nulls skipped.

    ``counts`` (non-null) and ``ends`` (minimum, maximum) are used where the caller has them already.
    """
    columns = list(columns)
    if not columns:
        return {}
    if counts is None:
        v = {c: ref(c).cast("double") for c in columns}
        got = measure(df, {(c, k): f(v[c]) for c in columns for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))})
        counts = {c: got[c, "n"] for c in columns}
        ends = {c: (got[c, "lo"], got[c, "hi"]) for c in columns if counts[c]}
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns if not counts[c]}
    live = [c for c in columns if counts[c]]
    if not live:
        return result
    if max(counts[c] for c in live) <= built_in_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        result.update(measure(df, {c: F.percentile(ref(c).cast("double"), wanted) for c in live}))
        return result

    positions = {c: [(counts[c] - 1) * p for p in probs] for c in live}
    ranks = {c: {k for x in positions[c] for k in (math.floor(x), math.ceil(x))} for c in live}
    values = _order_statistics(df, ranks, counts, ends or {})
    for c in live:
        row = []
        for x in positions[c]:
            low, high = values[c][math.floor(x)], values[c][math.ceil(x)]
            # the weights of the built-in aggregate, so both paths agree to the last digit
            row.append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
        result[c] = row
    return result


def _columns_of_keys(batches: Iterator[pa.RecordBatch], wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for at in wanted:
            column = batch.column(at).drop_null()
            if len(column):
                yield at, keys_of(column.to_numpy(zero_copy_only=False))


def _rows_of(df: DataFrame, columns: list[str], ranges: list[_Range], first: bool) -> DataFrame:
    """The columns that ranges lie in; after the first pass only rows that lie in one."""
    v = [ref(c).cast("double") for c in columns]
    if not first:
        inside = F.lit(False)
        for r in ranges:
            lo, hi = values_of([r.lo, r.hi]).tolist()
            inside = inside | (v[r.at] + 0.0).between(F.lit(lo), F.lit(hi))
        df = df.where(inside)
    return df.select(*[x.alias(f"v{i}") for i, x in enumerate(v)])


def _counted(rows: DataFrame, ranges: list[_Range]) -> list[tuple[np.ndarray, ...]]:
    """Per range: the bins with rows in ascending order, their counts, least and greatest keys."""
    wanted = {r.at for r in ranges}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ranges), BINS), np.int64)
        lo, hi = np.full_like(n, _LOW), np.full_like(n, -_LOW - 1)
        for at, keys in _columns_of_keys(batches, wanted):
            for i, r in enumerate(ranges):
                if r.at == at:
                    own = keys[(keys >= r.lo) & (keys <= r.hi)]
                    bins = r.bins(own)
                    n[i] += np.bincount(bins, minlength=BINS)
                    np.minimum.at(lo[i], bins, own)
                    np.maximum.at(hi[i], bins, own)
        i, b = np.nonzero(n)
        columns = [i.astype(np.int32), b.astype(np.int32), n[i, b], lo[i, b], hi[i, b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "bin", "n", "lo", "hi"])

    counted = rows.mapInArrow(count, "i int, bin int, n long, lo long, hi long")
    # at most BINS rows a range
    summed = counted.groupBy("i", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    i, b, n, lo, hi = (summed.column(c).to_numpy() for c in ("i", "bin", "n", "lo", "hi"))
    order = np.lexsort((b, i))
    cuts = np.searchsorted(i[order], np.arange(len(ranges) + 1))
    return [tuple(c[order[x:y]] for c in (n, lo, hi)) for x, y in zip(cuts, cuts[1:])]


def _read(rows: DataFrame, ranges: list[_Range]) -> list[np.ndarray]:
    """The sorted keys inside each range."""
    wanted = {r.at for r in ranges}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in ranges]
        for at, keys in _columns_of_keys(batches, wanted):
            for i, r in enumerate(ranges):
                if r.at == at:
                    held[i].append(keys[(keys >= r.lo) & (keys <= r.hi)])
        full = [(i, np.concatenate(h).tobytes()) for i, h in enumerate(held) if sum(map(len, h))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in full], pa.int32()), pa.array([k for _, k in full], pa.binary())], ["i", "keys"])

    found: list[list[bytes]] = [[] for _ in ranges]
    table = rows.mapInArrow(read, "i int, keys binary").toArrow()
    for i, keys in zip(table.column("i").to_pylist(), table.column("keys").to_pylist()):
        found[i].append(keys)
    return [np.sort(np.frombuffer(b"".join(f), np.int64)) for f in found]


def _order_statistics(
    df: DataFrame, ranks: dict[str, set[int]], counts: dict[str, int], known: dict[str, tuple[float, float]]
) -> dict[str, dict[int, float]]:
    columns = list(ranks)
    found: list[dict[int, float]] = [{} for _ in columns]
    ranges = []
    for at, c in enumerate(columns):
        ends = [float(x) for x in known.get(c, (-math.inf, math.nan))]
        lo, hi = keys_of(np.array(ends)).tolist()
        ranges.append(_Range(at, lo, hi, 0, counts[c], set(ranks[c])))
    first = True
    while ranges:
        rows = _rows_of(df, columns, ranges, first)
        if sum(r.inside for r in ranges) <= READ:
            for r, keys in zip(ranges, _read(rows, ranges)):
                found[r.at].update({k: float(values_of(keys[k - r.below])) for k in r.ranks})
            break
        following = []
        for r, (n, lo, hi) in zip(ranges, _counted(rows, ranges)):
            below = r.below + np.cumsum(n) - n
            for k in sorted(r.ranks):
                b = int(np.searchsorted(below, k, "right")) - 1
                if lo[b] == hi[b]:
                    found[r.at][k] = float(values_of(lo[b]))
                elif following and (following[-1].at, following[-1].lo) == (r.at, int(lo[b])):
                    following[-1].ranks.add(k)
                else:
                    # where one bin took most rows, the next digit is one of the other kind
                    even = r.even != (2 * int(n[b]) > r.inside)
                    following.append(_Range(r.at, int(lo[b]), int(hi[b]), int(below[b]), int(n[b]), {k}, even))
        ranges, first = following, False
    return {c: found[at] for at, c in enumerate(columns)}
