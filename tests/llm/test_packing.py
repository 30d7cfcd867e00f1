import itertools
import re

import numpy as np

from millrace.llm import packing as P
from pyspark.sql import functions as F


def cost(lengths, counts, cuts):
    return sum(n * (min(c for c in cuts if c >= x) - x) for x, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        counts = rng.integers(1, 20, len(lengths))
        k = int(rng.integers(1, 6))
        got = P.best_boundaries(lengths, counts, k)
        assert len(got) <= k and got[-1] == lengths[-1]
        choices = (s for r in range(min(k, len(lengths))) for s in itertools.combinations(lengths[:-1].tolist(), r))
        assert cost(lengths, counts, got) == min(cost(lengths, counts, [*s, lengths[-1]]) for s in choices)


def test_grid(spark):
    exact, coarse = P.grid_length(F.col("id"), None).alias("e"), P.grid_length(F.col("id"), 1024).alias("g")
    x = spark.range(0, 300_000, 7).select("id", exact, coarse).toPandas()
    assert (x.e == x.id).all()
    assert (x.g >= x.id).all() and (x.g - x.id <= x.id / 1024).all() and (x.g == x.id)[x.id <= 4096].all()


def check(rows, got, buckets, budget):
    sizes = sorted(len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in rows)
    assert sorted(r["size"] for r in got) == sizes
    lengths, counts = np.unique(sizes, return_counts=True)
    grid = P.best_boundaries(lengths, counts, buckets)
    assert sorted({r.boundary for r in got}) == grid
    batches = {}
    for r in got:
        assert r.boundary == min(c for c in grid if c >= r["size"]) and r.padding == r.boundary - r["size"]
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        fits = max(1, budget // max(held[0].boundary, 1))
        assert sorted(r.slot for r in held) == list(range(len(held))) and len(held) <= fits
        assert len(held) == fits or batch == max(b for k, b in batches if k == bucket)


def test_documents(docs, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    texts = [r.text for r in docs.select("text").collect()]
    check(texts, P.pack(docs, buckets=5, budget=3000).collect(), 5, 3000)


def test_edges(edges, edge_rows):
    check([r[1] for r in edge_rows], P.pack(edges, buckets=3, budget=20).collect(), 3, 20)
    found = P.pack(edges, grid=1024).collect()
    assert len(found) == len(edge_rows) and all(r.padding >= 0 for r in found)


def test_long_texts_keep_exact_boundaries(spark):
    """Lengths beyond 4,096 words, close to each other: no grid could tell them apart."""
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in np.concatenate([rng.integers(0, 60, 200), rng.integers(20_000, 20_060, 40), rng.integers(5000, 9000, 40)])]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(4)
    check(["w " * n for n in sizes], P.pack(docs, buckets=6, budget=50_000).collect(), 6, 50_000)


def test_empty(nothing):
    assert P.pack(nothing).collect() == []


def test_reruns_agree(edges):
    a, b = (sorted(map(repr, P.pack(x).collect())) for x in (edges, edges.repartition(5)))
    assert a == b
