"""Helpers the operators share: text units, scratch tables, skew-safe joins, batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.workspace import materialise, scratch_path

__all__ = ["Numbering", "SPACES", "bounded_batches", "bounded_slices", "documents", "empty_like", "mark_maybe", "materialise", "n_words", "process_memory", "scratch_path", "skew_join", "small_batches", "text_slices", "words"]

# The separators of words, as a regular expression and as characters.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

# A key with at least 1 / HOT_KEYS of all rows is hot; there are HOT_KEYS of them at most.
HOT_KEYS = 2000
# Largest size in bits of a filter over keys; it is broadcast as FILTER_BITS / 8 bytes at most.
FILTER_BITS = 1 << 26
# Bytes of an Arrow batch of texts, up to one row more.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Maximal runs of non-separators, in order; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def n_words(text: Column) -> Column:
    """How many words a text has, without building them."""
    blanked = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(blanked, SPACES, "")).cast("long")


def skew_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of ``facts`` that has the same non-null key.

    ``count`` is the number of rows of a key, ``total`` that of all rows. Keys with
    at least ``total / HOT_KEYS`` rows, so ``HOT_KEYS`` keys at most, are served by
    broadcast and never meet in one task; the others are joined by shuffle.
    """
    is_hot = F.col(count) * HOT_KEYS >= total
    hot = facts.where(is_hot)
    served = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return served.unionByName(rest.join(facts.where(~is_hot), key))


def mark_maybe(rows: DataFrame, keys: DataFrame, on: list[str], flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only if the row's ``on`` values are not in ``keys``.

    The filter is a bitmap over hashed values, so what is broadcast is bounded by
    ``bits / 8`` bytes whatever the number of keys. A true flag asks for an exact look.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    bitmap = (
        keys.select(place.alias("__mr_place"))
        .groupBy(F.bitmap_bucket_number("__mr_place").alias("__mr_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__mr_place")).alias("__mr_bits"))
    )
    at = F.bitmap_bit_position("__mr_place").cast("int")
    byte = F.conv(F.hex(F.substring("__mr_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at % 8)) != 0
    placed = rows.withColumn("__mr_place", place).withColumn("__mr_bucket", F.bitmap_bucket_number("__mr_place"))
    marked = placed.join(F.broadcast(bitmap), "__mr_bucket", "left").withColumn(flag, F.coalesce(hit, F.lit(False)))
    return marked.drop("__mr_place", "__mr_bucket", "__mr_bits")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class Numbering(dict):
    """Numbers for keys in order of first sight; ``pending`` lists those not yet taken care of."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.pending.append(key)
        return number

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def text_slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str]]:
    """``texts`` (null: empty) in lists of about ``chars`` characters, one text at least."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that run in the block send Python at most about ``size`` bytes at once.

    A batch of texts stands outside the JVM's heap, twice while its buffer grows, and
    again in the Python worker; Spark's own limit of 64 MB holds for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def process_memory(key: str, make):
    """The object kept under ``key`` in this Python process, made on first use.

    A worker process runs many tasks of a stage one after the other; what one has
    worked out (never a result, only what saves work) serves the next.
    """
    memory = sys.modules.setdefault("_millrace_memory", types.ModuleType("_millrace_memory"))
    if key not in vars(memory):
        setattr(memory, key, make())
    return getattr(memory, key)


def bounded_batches(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``chars`` bytes of text each.

    A slice has one row at least, so a very long text is a slice of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for end, size in enumerate(sizes.tolist()):
            if end > start and held + size > chars:
                yield batch.slice(start, end - start)
                start, held = end, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def bounded_slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """``bounded_batches`` with the texts of each (null: empty)."""
    for part in bounded_batches(batches, text, chars):
        yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
