import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import quality_gbt as G, queries as Q


def walk(forest, row):
    """One row through all trees, node by node."""
    total = forest.base
    for at in forest.roots.tolist():
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return total


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    return x, y


def test_arrays_give_what_walking_gives():
    x, y = data()
    forest = G.fit(x, y)
    assert np.allclose(forest.raw(x), [walk(forest, row) for row in x])
    assert ((forest.probability(x) >= 0.5) == y).mean() > 0.97


def test_first_split_is_the_best():
    """Histogram and sibling subtraction find the split that trying all values finds."""
    x, y = data(200)
    forest = G.fit(x, y, trees=1, depth=1, bins=256, shrink=1.0, least_rows=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, t):
        left = x[:, f] <= t
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left) if s.any())

    best = max(gain(f, t) for f in range(4) for t in np.unique(x[:, f])[:-1])
    root = forest.roots[0]
    assert gain(forest.feature[root], forest.threshold[root]) == pytest.approx(best)


@given(st.integers(0, 30), st.integers(0, 2))
@settings(max_examples=30, deadline=None)
def test_small_samples(n, kind):
    x, y = data(max(n, 1), n)
    x, y = x[:n], y[:n]
    y = y if kind == 2 else np.full(n, float(kind))
    p = G.fit(x, y).probability(np.zeros((3, 4)))
    assert ((p > 0) & (p < 1)).all()


def test_held_out(spark):
    found = Q.QUERIES["op10_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").toPandas()
    assert found.count() == 1000 and rows.score.between(0, 1).all()
    assert (rows.predicted == rows.quality)[rows.held_out].mean() > 0.95
    assert (rows.predicted == (rows.score >= 0.3)).all()


def test_sample_is_bounded_and_settled(spark):
    """An id with both labels is 1; a repeated id brings one row, whatever the order."""
    rows = [(1, "one"), (2, "b"), (2, "a"), (3, "three"), (None, "none")] + [(4, "same")] * 5000
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 2), (4, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    found = []
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = G.labelled_sample(docs, labels.repartition(parts), "quality", F.lit(True), 100)
        found.append(sorted((r["text"], r["__mr_y"]) for r in got.collect()))
    assert found[0] == found[1] and len(found[0]) == 3
    assert {("one", 1), ("same", 1)} < set(found[0]) and found[0][0] in {("a", 0), ("b", 0)}


def test_edges(edges, edge_rows, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (6, 0, 0), (77, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    forest = G.train(edges, labels, F.lit(True))
    rows = G.score(edges, forest, ["doc_id"]).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    assert G.train(nothing, labels, F.lit(True)).probability(np.zeros((1, 10)))[0] == pytest.approx(0.5)
    assert G.score(nothing, forest, ["doc_id"]).collect() == []
