"""Duplicate rows: plain removal, and a counted form that avoids shuffling wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import POSITION, data_columns, ref
from ..workspace import materialise_observed

# A set of 8-byte row hashes up to this many is broadcast.
BROADCAST_HASHES = 1_000_000


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One copy of every row; null equals null. With a row position, the earliest stays."""
    if POSITION not in df.columns:
        return df.dropDuplicates()
    columns = data_columns(df)
    return (
        df.groupBy(*[ref(c) for c in columns])
        .agg(F.min(POSITION).alias(POSITION))
        .select(*[ref(c) for c in df.columns])
    )


def drop_duplicates_counted(df: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows without duplicates, rows before, duplicates removed).

    Equal rows have equal hashes, so one shuffle of 8-byte hashes shows which rows
    can have a copy at all. A table without any comes back as it is: no wide
    shuffle, and later jobs still scan the source with pruned columns. Otherwise
    only the suspects are compared in full (a hash collision just adds suspects).
    """
    row_hash = F.xxhash64(*[ref(c) for c in data_columns(df)])
    groups = df.groupBy(row_hash.alias("__hash")).agg(F.count(F.lit(1)).alias("__n"))
    shared = F.col("__n") > 1
    found = groups.agg(
        F.sum("__n").alias("rows"),
        F.count_if(shared).alias("hashes"),
        F.coalesce(F.sum(F.when(shared, F.col("__n"))), F.lit(0)).alias("suspects"),
    ).first()
    rows, hashes = found["rows"] or 0, found["hashes"]
    if not hashes:
        return df, rows, 0
    if hashes > BROADCAST_HASHES or found["suspects"] * 2 > rows:
        unique = drop_duplicates(df)
    else:
        suspect_hashes = F.broadcast(groups.where(shared).select("__hash"))
        hashed = df.withColumn("__hash", row_hash)
        suspects = hashed.join(suspect_hashes, "__hash", "left_semi").select(*[ref(c) for c in df.columns])
        rest = hashed.join(suspect_hashes, "__hash", "left_anti").select(*[ref(c) for c in df.columns])
        unique = rest.unionByName(drop_duplicates(suspects))
    unique, kept = materialise_observed(unique, "dedupe", {"rows": F.count(F.lit(1))})
    return unique, rows, rows - kept["rows"]
