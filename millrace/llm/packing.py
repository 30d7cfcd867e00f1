"""Packing by optimal length buckets and token-budget batches.

The lengths of all documents are counted in one histogram. Dynamic programming over
it chooses the bucket boundaries that minimise padding: a document is padded to the
boundary of its bucket, the cost of a bucket is ``boundary * documents - words``.
That cost lets the best previous boundary be found on a lower envelope of lines, so
the program takes ``buckets * lengths`` steps and its result is exact.

Inside a bucket with boundary L a batch takes ``budget // L`` documents (one, where
L exceeds the budget). Documents of a bucket are put in a random but fixed order by
hash; ranks come from sorted ranges of bounded size plus their offsets, so no bucket
meets in one task, and all batches of a bucket but its last are full.

The histogram holds every length that occurs, so it has no more rows than the longest
text has words, however many documents there are. A caller with lengths beyond that may
ask for a ``grid``: lengths above four times it are then rounded up to ``grid`` steps
per doubling, at a padding of at most 1 / grid.

Defined results: null texts and texts without a word have length 0 and their own
boundary 0 if it pays; ties and repeated rows are ordered by id, then by the hash of
the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import empty_like, materialise, n_words

BUCKETS = 16
BUDGET = 65_536
RANGE_ROWS = 50_000
SCHEMA = "doc_id long, size long, bucket int, boundary long, batch long, slot long, padding long"


def grid_length(size: Column, grid: int | None) -> Column:
    """``size``; with a ``grid``, sizes above four times it are rounded up to ``grid`` steps per doubling."""
    if grid is None:
        return size
    # step: the largest power of two of which ``grid`` fit below the size
    power = F.greatest(F.floor(F.log2(F.greatest(size - 1, F.lit(1)).cast("double") / grid)), F.lit(0))
    step = F.pow(F.lit(2.0), power).cast("long")
    return F.when(size <= 4 * grid, size).otherwise(F.ceil(size / step) * step).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries among ``lengths`` (ascending) with the least padding.

    best[k][j]: least cost of the first j lengths in k buckets. With N the documents up
    to a length, best[k][j] = L_j * N_j + min over i of (best[k-1][i] - L_j * N_i): the
    lower envelope, at L_j, of lines with slope -N_i. The words themselves are a
    constant. Of equally good choices the earlier boundary wins.
    """
    m = len(lengths)
    upto = [0, *np.cumsum(counts).tolist()]
    ends = [0, *lengths.tolist()]
    best = [ends[j] * upto[j] for j in range(m + 1)]
    picks = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        now, pick = [0] * (m + 1), [0] * (m + 1)
        hull: list[int] = []
        top = 0

        def useless(a: int, b: int, c: int) -> bool:
            """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
            return (best[c] - best[a]) * (upto[b] - upto[a]) <= (best[b] - best[a]) * (upto[c] - upto[a])

        for j in range(1, m + 1):
            i = j - 1
            while len(hull) - top >= 2 and useless(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            at = lambda x: best[x] - ends[j] * upto[x]  # noqa: B023, E731
            while len(hull) - top >= 2 and at(hull[top + 1]) < at(hull[top]):
                top += 1
            now[j], pick[j] = ends[j] * upto[j] + at(hull[top]), hull[top]
        best = now
        picks.append(pick)
    cuts, j = [], m
    for pick in reversed(picks):
        if not j:
            break
        cuts.append(ends[j])
        j = pick[j]
    return cuts[::-1]


def pack(
    docs: DataFrame, *, buckets: int = BUCKETS, budget: int = BUDGET, size: Column | None = None, grid: int | None = None
) -> DataFrame:
    """Bucket, batch and slot of every row of ``docs``.

    ``size`` is the length of a row in tokens (words of ``text``, unless given).
    """
    spark = docs.sparkSession
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (n_words(F.col("text")) if size is None else size.cast("long")).alias("size"),
            F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias("tie"),
        ),
        "lengths",
    )
    histogram = rows.groupBy(grid_length(F.col("size"), grid).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    counted = sorted((r["length"], r["n"]) for r in histogram.collect())
    if not counted:
        return empty_like(spark, SCHEMA)
    cuts = best_boundaries(np.array([c[0] for c in counted]), np.array([c[1] for c in counted]), buckets)
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    bucket = F.size(F.filter(bounds, lambda b: b < grid_length(F.col("size"), grid)))
    per_bucket = [sum(n for length, n in counted if (cuts[k - 1] if k else -1) < length <= c) for k, c in enumerate(cuts)]
    ranges = F.array(*[F.lit(-(-n // RANGE_ROWS)).cast("long") for n in per_bucket])
    dealt = rows.withColumn("bucket", bucket).withColumn(
        "range", F.pmod("tie", F.element_at(ranges, F.col("bucket") + 1))
    )
    # ranks: position in the range, plus the rows of the bucket's earlier ranges
    offsets = dealt.groupBy("bucket", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("bucket", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    place = Window.partitionBy("bucket", "range").orderBy("tie", F.col("doc_id").asc_nulls_last())
    ranked = dealt.withColumn("place", F.row_number().over(place)).join(offsets, ["bucket", "range"])
    boundary = F.element_at(bounds, F.col("bucket") + 1)
    fits = F.greatest(F.floor(F.lit(budget) / F.greatest(boundary, F.lit(1))), F.lit(1)).cast("long")
    rank = F.col("offset") + F.col("place") - 1
    return ranked.select(
        "doc_id",
        "size",
        "bucket",
        boundary.alias("boundary"),
        F.floor(rank / fits).cast("long").alias("batch"),
        F.pmod(rank, fits).alias("slot"),
        (boundary - F.col("size")).alias("padding"),
    )
