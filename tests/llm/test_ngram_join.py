import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import ngram_join as J

SPACE = "[^\x20\x09-\x0d]+"
CLASSES = np.random.default_rng(1).integers(0, 4, 1 << J.SKETCH_BITS, np.uint8)


def shingles(text):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) < 5:
        return {" ".join(w)} if w else set()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """(doc_id, n, component) by comparing all pairs of whole sets."""
    sets = [shingles(t) for _, t in rows]
    own = list(range(len(rows)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                own[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(rng, n, words=60, edits=6):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@given(st.lists(st.sampled_from("aAbcé  \t\n\x1c."), max_size=60))
@settings(max_examples=200, deadline=None)
def test_sets(parts):
    text = "".join(parts)
    own = J.shingle_sets([text])[0]
    assert len(own) == len(shingles(text))
    assert np.array_equal(own, np.unique(own))
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    assert np.array_equal(own, J.shingle_sets(["", re.sub("[\x20\t\n]+", "  ", lower), "z"])[1])


@given(st.integers(1, 300), st.data())
@settings(max_examples=200, deadline=None)
def test_prefixes_of_any_level_share_as_much(n, data):
    """The bound behind the method: linked sets share l elements of their prefixes, for every level."""
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    x = rng.sample(range(10**6), n)
    y = [e for e in x if rng.random() > 0.08] + rng.sample(range(10**6, 2 * 10**6), rng.randint(0, n // 6))
    classes = CLASSES
    x, y = (np.sort(np.array([e * 0x9E3779B97F4A7C15 % 2**64 for e in s], np.uint64)) for s in (x, y))
    both = len(np.intersect1d(x, y))
    if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
        return
    px, py = J.ordered_prefix(x, classes), J.ordered_prefix(y, classes)
    for level in range(1, min(J.highest_level(len(x)), J.highest_level(len(y))) + 1):
        cut = [p[: len(s) - J.required(len(s)) + level] for p, s in ((px, x), (py, y))]
        assert len(np.intersect1d(*cut)) >= level


@pytest.mark.parametrize("split", [0, 20])
def test_blocks(split):
    rng = random.Random(split)
    sets = J.shingle_sets(near_copies(rng, 25) + near_copies(rng, 15, 12, 2))
    rng.shuffle(sets)
    classes = np.zeros(1 << J.SKETCH_BITS, np.uint8)
    prefix = [J.ordered_prefix(s, classes).view(np.int64) for s in sets]
    levels = np.array([rng.randint(1, J.highest_level(len(s))) for s in sets])
    firsts = [np.maximum(1, np.arange(len(p)) - (len(s) - J.required(len(s)) + 1) + 2).astype(np.uint8) for p, s in zip(prefix, sets)]
    child, root = J.block_links(np.array([len(s) for s in sets]), levels, prefix, firsts, sets, split)
    forest = J.Forest(len(sets))
    forest.join(child, root)
    want = J.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (not split or j < split <= i) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.join(np.array([i]), np.array([j]))
    assert np.array_equal(forest.find(np.arange(len(sets))), want.find(np.arange(len(sets))))


@pytest.mark.parametrize(("tile", "homes"), [(512, 3), (16, 1)])
def test_groups_of_near_copies(spark, monkeypatch, tile, homes):
    """Small tiles deal blocks out in pairs; one home only leaves many pairs to the counted way."""
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "HOMES", homes)
    rng = random.Random(tile)
    texts = near_copies(rng, 90) + near_copies(rng, 40, 300, 20) + near_copies(rng, 30, 7, 1) + near_copies(rng, 20, 3, 1)
    shared = near_copies(rng, 1, 50)[0]
    texts += [f"{shared} {' '.join(f'{i}-{k}' for k in range(40))}" for i in range(30)] + [None, "", " \n"] + texts[:40]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(J.join(docs)) == brute(rows)


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(J.join(docs)) == brute(rows)


def test_edges(edges, edge_rows, nothing):
    assert got(J.join(edges)) == brute([(r[0], r[1]) for r in edge_rows])
    assert J.join(nothing).collect() == []


def test_one_text_on_100_000_rows(spark):
    copies = spark.range(100_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    near = spark.createDataFrame([(-5, "one two three four five six seven eight"), (-7, "one two")], "doc_id long, text string")
    rows = J.join(copies.unionByName(near)).groupBy("component_id", "n_shingles").count().collect()
    assert sorted(map(tuple, rows)) == [(-7, 1, 1), (-5, 4, 1), (0, 3, 100_000)]
