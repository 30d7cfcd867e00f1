import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import credentials as C

NAMES = ["assign", "access", "hex"]
HEX = "0123456789abcdef" * 3
LIVE = "sk9Zq7Lm2Xv4Rt8Yb3Wc6Hd1"
COPIED = "Ab3dE5gH7jK9mN2pQ4sT6vW8"


def brute(text):
    text = text or ""
    pattern = "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(NAMES[k], s, e) for s, k, e in sorted(found)]


@given(st.lists(st.sampled_from(
    ["password", "Token", "secret", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abc", "AKIA", "AKIA" + "X" * 16, HEX, "é", "K", "ſecret", "x.y="]
), max_size=14))
@settings(max_examples=400, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    got = sorted(((s, NAMES.index(k), e) for k, s, e, _ in C.base_spans(text)))
    assert [(NAMES[k], s, e) for s, k, e in got] == brute(text)


def check(rows, got):
    assert len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append(brute(text))
    for r in got:
        base = want[r.doc_id][0]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for k, _, _ in base) for n in NAMES)
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("token")] == (written.split(",") if written else [])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], C.scan(docs).collect())


def test_edges(edges, edge_rows, nothing):
    rows = [r for r in edge_rows if r[0] is not None]
    got = C.scan(edges).collect()
    check([r[:2] for r in rows], [r for r in got if r.doc_id is not None])
    assert len(got) == len(edge_rows) and C.scan(nothing).collect() == []


def test_ownership_parts_copied_from_live(spark):
    rows = [(i, f"use {COPIED} here, api_key = {HEX}", "en", f"s{i}", 0) for i in range(6)]
    rows += [(10, f"é {LIVE} and {COPIED}", "en", "s1", 0), (11, f"é {LIVE}", "en", "s1", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r for r in C.scan(frame).collect()}
    assert got[10].spans == f"token:2:{2 + len(LIVE)}" and (got[10].n_added, got[10].n_copied) == (1, 1)
    assert got[11].n_added == 1 and got[0].n_added == 0 and got[0].n_copied == 3
    assert got[0].spans.startswith("assign:") and ",hex:" in got[0].spans


def test_value_in_many_texts_of_one_source_is_copied(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i} uses {COPIED}", "en", "hot", 0) for i in range(30)]
    # exact copies of a document are one text
    rows += [(100 + i, f"mine is {LIVE}", "en", "hot", 0) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = C.scan(frame).collect()
    assert {(r.n_added, r.n_copied) for r in got if r.doc_id < 100} == {(0, 1)}
    assert {(r.n_added, r.n_copied) for r in got if r.doc_id >= 100} == {(1, 0)}
    # given owners decide alone
    given = C.scan(frame, owner=F.col("source"), repository=F.col("source")).collect()
    assert {r.n_added for r in given} == {1}


def test_long_lists_of_spans_take_one_sweep():
    import time

    text = "\n".join(f"{LIVE}{i % 90 + 10} {HEX} password = abcdef{i}" for i in range(30_000))
    start = time.perf_counter()
    base = C.base_spans(text)
    assert (len(base), len(C.added_candidates(text, base))) == (60_000, 30_000)
    assert time.perf_counter() - start < 20


@given(st.lists(st.sampled_from([LIVE, HEX, COPIED, " ", "=", "token=", "AKIA" + "X" * 16, "/", "z"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_sweep_finds_what_comparing_all_spans_finds(parts):
    text = "".join(parts)
    base = C.base_spans(text)
    want = [m.span() for m in C.TOKEN.finditer(text) if not any(m.start() < e and s < m.end() for _, s, e, _ in base)]
    mixed = [w for w in want if all(re.search(p, text[slice(*w)]) for p in ("[0-9]", "[a-z]", "[A-Z]"))]
    assert [x[1:3] for x in C.added_candidates(text, base)] == [w for w in mixed if C.entropy(text[slice(*w)]) >= C.LEAST_BITS]


@pytest.mark.parametrize("text,n", [("plain words only", 0), ("A" * 40, 0), (LIVE, 1), (f"token={LIVE}", 0)])
def test_candidates(text, n):
    assert len(C.added_candidates(text, C.base_spans(text))) == n
