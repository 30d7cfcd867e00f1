import hashlib
import re

from pyspark.sql import functions as F

from millrace.llm import exact_stream as E


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (doc_id, _), text in zip(rows, norm):
        groups.setdefault(text, []).append(doc_id)
    out = []
    for (doc_id, _), text in zip(rows, norm):
        known = [i for i in groups[text] if i is not None]
        out.append((doc_id, min(known) if known else None, len(groups[text]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(found, rows):
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_edges(edges, edge_rows):
    check(E.deduplicate(edges), [r[:2] for r in edge_rows])


def test_equal_digests_of_different_texts(edges, edge_rows):
    """A key of four bits makes false hits; the full bytes refute them."""
    weak = E.deduplicate(edges, key=lambda sha: F.substring(F.hex(sha), 1, 1).cast("binary"))
    check(weak, [r[:2] for r in edge_rows])


def test_documents(docs):
    check(E.deduplicate(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty(nothing):
    assert E.deduplicate(nothing).collect() == []
    assert E.keep_rows(nothing, E.deduplicate(nothing)).collect() == []


def test_kept_rows_are_whole(edges, edge_rows):
    kept = E.keep_rows(edges, E.deduplicate(edges))
    assert kept.columns == edges.columns
    rows = kept.collect()
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in edge_rows})
    assert all(tuple(r) in edge_rows for r in rows)


def test_state_goes_on(spark, tmp_path):
    """Rows that arrive later meet the digests of earlier runs: nothing expires."""
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "key binary, doc_id long, file string, row long"
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", E.PROVIDER)
    for rows in ([(b"a", 5, "f", 0), (b"b", 6, "f", 1)], [(b"a", 3, "g", 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        E.update_state(session.readStream.schema(schema).parquet(folder), checkpoint)
    state = {bytes(r.key): (r["first"].doc_id, r.n) for r in E.read_state(spark, checkpoint).collect()}
    assert state == {b"a": (3, 2), b"b": (6, 1)}


def test_no_python_on_the_main_path(docs):
    plan = E.deduplicate(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
