import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M


def brute_targets(sizes, weights=M.WEIGHTS, most=M.MOST):
    """Share by weight; stop at the bound and share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(frame, near):
    rows = [(r.source, r.text) for r in frame.select("source", "text").collect()]
    sizes = {}
    for source, text in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    got = M.mix(frame.withColumn("whose", frame["source"]), row="whose").collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(sizes.values())
    target, taken = brute_targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.whose] and r.target == pytest.approx(target[r.whose])
        assert r.taken == r["size"] * r.copies and 0 <= r.taken <= 3 * r["size"]
        taken[r.whose] = taken.get(r.whose, 0) + r.taken
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= near(wanted)


@pytest.mark.parametrize(
    "sizes",
    [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 500, "d": 2, None: 30}, {"a": 5}, {None: 7, "é": 9, "z": 4, "Z": 100}],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_documents(docs):
    check(docs, lambda wanted: max(0.03 * wanted, 60))


def test_edges(edges, edge_rows):
    got = M.mix(edges).collect()
    assert len(got) == len(edge_rows)
    assert all(r.taken == 0 for r in got if not r["size"]) and all(r.taken <= 3 * r["size"] for r in got)


def test_equal_rows_are_spread(spark):
    """100,000 equal rows without an id: no group of the diffusion holds them all, and the targets are met."""
    same = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'five words stand right here' text", "'a' source")
    other = spark.range(3000).selectExpr("id doc_id", "concat('one more text of words ', id) text", "'b' source")
    got = M.mix(same.unionByName(other)).groupBy("source_size").agg(
        F.count(F.lit(1)).alias("n"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("most")
    )
    for r in got.collect():
        assert r.n in (100_000, 3000) and r.most <= 3 and abs(r.taken - r.target) <= 0.01 * r.target


def test_empty(nothing):
    assert M.mix(nothing).collect() == []
    assert M.take_copies(nothing).collect() == []


def test_reruns_agree(docs):
    a, b = (sorted(tuple(r) for r in M.mix(x).collect()) for x in (docs, docs.repartition(7)))
    assert a == b


def test_copies_are_taken(docs):
    want = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    got = {}
    for r in M.take_copies(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
