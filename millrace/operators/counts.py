"""Value counts of many columns at once, top-k, category sizes, distinct counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import is_integral, ref
from .measure import measure

# Up to this many rows distinct values of all columns are counted in one job.
EXACT_DISTINCT_ROWS = 2_000_000
# Texts longer than this on average are counted by digest, so a shuffle carries 32 bytes per text.
LONG_TEXT_BYTES = 128
# Up to this many digests are broadcast to fetch their texts.
BROADCAST_DIGESTS = 100_000


def value_counts(df: DataFrame, columns: Sequence[str], dtype: str = "string") -> DataFrame:
    """Tall (column, value, n) of the non-null values.

    One shuffle for all columns; partial aggregation folds a hot value into one
    row per map task before it.
    """
    cells = [x for c in columns for x in (F.lit(c), ref(c).cast(dtype))]
    return (
        df.select(F.stack(F.lit(len(columns)), *cells).alias("column", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_of_counts(counts: DataFrame, k: int) -> DataFrame:
    """Most frequent ``k`` values per column, equal counts in value order.

    The rank filter lets Spark keep only k rows per column and partition before
    the exchange on ``column``.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    return top_of_counts(value_counts(df, columns), k)


def sizes_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("n").alias("n_rows"),
        F.sum(F.octet_length("value")).alias("n_bytes"),
    )


@dataclass(frozen=True)
class Levels:
    """What is known about the values of one categorical column."""

    n_unique: int
    n_rows: int
    n_bytes: int
    top: tuple[tuple[str, int], ...]
    k: int

    @property
    def complete(self) -> bool:
        """True when ``top`` lists every value."""
        return self.n_unique <= self.k

    def sorted_values(self) -> list[str]:
        # Code-point order, the order of Spark's binary string comparison.
        return sorted(v for v, _ in self.top)


def levels(df: DataFrame, columns: Sequence[str], k: int = 15) -> dict[str, Levels]:
    """Exact distinct counts and top-k of all columns from one pass over the data."""
    if not columns:
        return {}
    counts = value_counts(df, columns)
    # Both branches read the same aggregated exchange.
    tall = top_of_counts(counts, k).select(
        "column", "value", "n", "rank", F.lit(None).cast("bigint").alias("n_unique"), F.lit(None).cast("bigint").alias("n_bytes")
    ).unionByName(
        sizes_of_counts(counts).select(
            "column",
            F.lit(None).cast("string").alias("value"),
            F.col("n_rows").alias("n"),
            F.lit(0).alias("rank"),
            "n_unique",
            "n_bytes",
        )
    )
    sizes: dict[str, tuple] = {}
    tops: dict[str, list] = {c: [] for c in columns}
    for row in tall.collect():  # at most k + 1 rows per column
        if row["rank"] == 0:
            sizes[row["column"]] = (row["n_unique"], row["n"], row["n_bytes"])
        else:
            tops[row["column"]].append((row["rank"], row["value"], row["n"]))
    return {
        c: Levels(*sizes.get(c, (0, 0, 0)), top=tuple((v, n) for _, v, n in sorted(tops[c])), k=k) for c in columns
    }


def long_text_levels(df: DataFrame, column: str, k: int = 15, broadcast_digests: int = BROADCAST_DIGESTS) -> Levels:
    """``levels`` of one column of long texts, which are never shuffled as such.

    Texts are counted by their 128-bit digest; only those that can be among the
    top k are fetched, and equal counts are still ordered by the text itself.
    """
    text = ref(column)
    digested = df.where(text.isNotNull()).select(F.md5(text).alias("digest"), text.alias("value"))
    counts = digested.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("value")).alias("bytes")
    )
    # Both branches read the same aggregated exchange; at most k + 1 rows are collected.
    sizes = counts.agg(F.count(F.lit(1)).alias("a"), F.sum("n").alias("b"), F.sum("bytes").alias("c")).select(
        F.lit("sizes").alias("what"), "a", "b", "c"
    )
    largest = counts.groupBy("n").agg(F.count(F.lit(1)).alias("digests")).orderBy(F.desc("n")).limit(k)
    rows = sizes.unionByName(
        largest.select(F.lit("n").alias("what"), F.col("n").alias("a"), F.col("digests").alias("b"), F.lit(0).cast("bigint").alias("c"))
    ).collect()
    n_unique, n_rows, n_bytes = next((r["a"], r["b"] or 0, r["c"] or 0) for r in rows if r["what"] == "sizes")

    above = ties = 0  # texts more frequent than the last place, and as frequent as it
    last = None
    for n, digests in sorted(((r["a"], r["b"]) for r in rows if r["what"] == "n"), reverse=True):
        above, ties, last = above + ties, digests, n
        if above + ties >= k:
            break

    def fetch(wanted: DataFrame):
        found = digested.join(F.broadcast(wanted), "digest").select("value", "n").distinct()
        return [(r["value"], r["n"]) for r in found.orderBy(F.desc("n"), "value").limit(k).collect()]

    if last is None:
        top = []
    elif above + ties <= broadcast_digests:
        top = fetch(counts.where(F.col("n") >= last).select("digest", "n"))
    elif last == 1:
        # The places left go to the smallest of the texts that occur once.
        frequent = counts.where(F.col("n") > 1).select("digest", "n")
        single = digested.join(F.broadcast(frequent), "digest", "left_anti") if above else digested
        head = fetch(frequent) if above else []
        top = head + [(r["value"], 1) for r in single.select("value").orderBy("value").limit(k - above).collect()]
    else:
        ranked = top_of_counts(value_counts(df, [column]), k).orderBy("rank").collect()
        top = [(r["value"], r["n"]) for r in ranked]
    return Levels(n_unique, n_rows, n_bytes, tuple(top), k)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact non-null distinct counts, all columns in one job."""
    return measure(df, {c: F.count_distinct(ref(c)) for c in columns})


def distinct_share_reaches(
    df: DataFrame,
    columns: Sequence[str],
    rows: int,
    threshold: float,
    ends: dict[str, tuple] | None = None,
    exact_rows: int = EXACT_DISTINCT_ROWS,
) -> dict[str, bool]:
    """Per column: is distinct / rows >= threshold? Exact in tables of any size.

    ``ends`` are known (min, max) pairs: an integer column cannot hold more distinct
    values than its range is wide. All other columns are counted: up to ``exact_rows``
    rows in one job, which repeats every row per column; beyond that one column at a
    time, so the shuffle is never wider than the widest column.
    """
    verdict: dict[str, bool] = {}
    pending = []
    for c in columns:
        lo, hi = (ends or {}).get(c, (None, None))
        if is_integral(df, c) and lo is not None and hi - lo + 1 < threshold * rows:
            verdict[c] = False
        else:
            pending.append(c)
    if pending and rows > exact_rows:
        exact = {c: df.select(ref(c).alias("v")).where("v is not null").distinct().count() for c in pending}
    else:
        exact = distinct_counts(df, pending) if pending else {}
    verdict.update({c: exact[c] / rows >= threshold for c in pending})
    return {c: verdict[c] for c in columns}
