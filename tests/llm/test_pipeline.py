"""The whole pipeline against plain Python on the same rows, and the entry points without it."""

import re
import subprocess
import sys
import zlib
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import langid, simhash

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, docs):
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialise(stage(spark, kept, ""), f"test_{name}")
        seen[name] = kept
        if name != "length_packing":
            assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    first = {r.doc_id for r in seen["language_id"].collect()}
    assert first == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", rows[i].text) for i in first}
    least = {}
    for i in sorted(first):
        least.setdefault(norm[i], i)
    second = {r.doc_id for r in seen["exact_dedup"].collect()}
    assert second == set(least.values())
    third = {r.doc_id for r in seen["simhash_near_dedup"].collect()}
    assert third <= second and len(third) > 0.9 * len(second)
    mixed = [r.doc_id for r in seen["source_mix"].collect()]
    assert set(mixed) <= third and max(map(mixed.count, set(mixed))) <= 3
    packed = seen["length_packing"].collect()
    assert sorted(r.doc_id for r in packed) == sorted(mixed) and all(r.boundary >= r["size"] for r in packed)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "bucket", "batch", "slot"} <= set(out.columns) and out.count() > 0


def test_empty(spark, nothing):
    rows = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialise(stage(spark, rows, ""), "empty")
        assert rows.count() == 0


def test_letterless_texts_go_without_any_language(edges, edge_rows, spark):
    rows = edges.selectExpr("doc_id", "text", "cast(null as string) AS lang", "source", "n_chars")
    got = [r.text for r in corpus_pipeline.language(spark, rows, "").collect()]
    assert sorted(got) == sorted(r[1] for r in edge_rows if any(c.isalpha() for c in r[1] or ""))


@pytest.mark.parametrize("step", ["fingerprints", "languages", "identified"])
def test_texts_reach_python_in_small_batches(spark, monkeypatch, step):
    """Each batch of a task is held in the JVM and in Python: long texts must not add up to Spark's 64 MB."""
    texts = spark.range(0, 120, numPartitions=1).selectExpr(
        "id AS doc_id", "repeat('abcdefg ', 12500 + int(id)) AS text", "cast(null as string) AS lang", "'a' AS source", "id AS n_chars"
    )
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def measured(text):
        return F.pandas_udf(lambda t: pd.Series([int(t.str.len().sum())] * len(t)), "long")(text)

    if step == "fingerprints":
        stored = []
        keep = simhash.materialise
        monkeypatch.setattr(simhash, "marking", measured)
        monkeypatch.setattr(simhash, "materialise", lambda df, label: stored.append((label, out := keep(df, label))) or out)
        assert simhash.near_duplicates(texts).count() == 120
        sent = [r.fp for r in dict(stored)["fingerprints"].collect()]
    else:
        as_lang = lambda net, text: F.struct(measured(text).cast("string").alias("lang"), F.lit(1.0).alias("score"))
        monkeypatch.setattr(langid, "reading", as_lang)
        net = langid.new_network(["a", "b"])
        if step == "languages":
            sent = [int(r.lang_pred) for r in langid.identify(texts, net, ["doc_id"]).collect()]
        else:
            sent = [int(r.lang) for r in langid.keep_identified(texts, net).collect()]
    assert len(sent) == 120 and max(sent) < 5_000_000
    assert spark.conf.get(key) == before


def test_all_queries_are_registered():
    code = "import __spark_entry__ as e; q = e.queries(); print(sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    names = eval(said.stdout)
    assert "pipeline" in names and {n[2:].split("_")[0] for n in names if n != "pipeline"} == {str(i) for i in range(1, 14)}


def test_folds_follow_crc32(spark):
    from millrace.llm.queries import fold

    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows.select("doc_id", fold(5).alias("f")).collect())
