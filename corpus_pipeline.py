"""The corpus pipeline over ``documents``: clean, deduplicate, mix and pack.

Every stage takes what its predecessor kept and returns the columns of documents, the
last one the packing of what is left. ``run`` writes each stage to the shared scratch
folder and reads it again, so a lost executor costs a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import exact_stream, langid, mixing, packing, simhash
from millrace.llm.common import documents, materialise

# Newton steps, components and dynamic programming have no statement in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letter at all) go; a missing language is filled in."""
    net = langid.train(docs, F.lit(True))
    # without a labelled row there is no language to fill in, texts without a letter go all the same
    return langid.with_letters(docs) if net is None else langid.keep_identified(docs, net)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_stream.keep_rows(docs, exact_stream.deduplicate(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document as often as the mix takes it."""
    return mixing.take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches of the mix."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mix", mix),
    ("length_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
