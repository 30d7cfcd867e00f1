import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid as L, queries as Q


def test_gradients():
    """Backpropagation through time against differences."""
    net = L.new_network(["a", "b", "c"], 5)
    net.E, net.U = [w.astype(float) for w in net.E], [w.astype(float) for w in net.U]
    net.V, net.c = net.V.astype(float), net.c.astype(float)
    rng = np.random.default_rng(0)
    x, lengths, y = rng.integers(0, 256, (4, 6)), np.array([6, 3, 1, 5]), np.array([0, 1, 2, 1])
    _, grads = L.gradients(net, x, lengths, y)
    for w, g in zip([*net.E, *net.U, net.V, net.c], grads):
        for at in list(zip(*np.nonzero(g)))[::37][:6]:
            kept, h = w[at], 1e-2
            w[at] = kept + h
            up, _ = L.gradients(net, x, lengths, y)
            w[at] = kept - h
            down, _ = L.gradients(net, x, lengths, y)
            w[at] = kept
            assert abs((up - down) / (2 * h) - g[at]) < 1e-4


def test_document_is_the_mean_over_positions():
    """Remembered runs give what reading every position of the document gives."""
    net = L.new_network(["a", "b"], 6)
    text = "Ein Wörtchen 12 und " + "lang" * 40 + " ein"
    want = []
    for run in L.LETTERS.findall(text.lower()):
        for piece in L.pieces_of(run):
            want.append(L.position_probabilities(net, np.frombuffer(piece, np.uint8)[None, :])[0])
    assert np.allclose(L.Reader(net).read([text, ""])[0], np.concatenate(want).mean(axis=0), atol=1e-5)
    assert sum(e - s for s, e, _ in L.label_positions(net, text)) == sum(len(p) for p in want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = Q.QUERIES["op4_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.lang == found.lang_pred)[found.held_out].mean() > 0.97


def test_edges(edges, edge_rows, nothing):
    net = L.train(edges, F.lit(True))
    rows = L.identify(edges, net, ["doc_id", "text", "score", "lang"]).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.lang_pred in {"und", "de", "en"})
    kept = L.keep_identified(edges, net)
    assert kept.columns == edges.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in edge_rows)
    assert kept.where("lang is null").count() == 0
    assert L.train(nothing, F.lit(True)) is None
    assert L.identify(nothing, net, ["doc_id"]).collect() == []
    assert {r.lang_pred for r in L.identify(edges, None, ["doc_id"]).collect()} == {"und"}
    assert L.keep_identified(edges, None).count() == len(edge_rows)
