import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from millrace.llm import simhash as S


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(values, group=None):
    values = np.asarray(values, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= S.RADIUS
    if group is not None:
        near &= group[:, None] == group[None, :]
    out = np.arange(len(values))
    while True:
        new = np.array([out[row].min() for row in near], int)
        new = new[new] if len(new) else new
        if (new == out).all():
            return out
        out = new


def linked(n, child, root):
    out = np.arange(n)
    out[child] = root
    return out


def near_values(rng, n=40, copies=30):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) for _ in range(copies)]
    return np.unique(np.concatenate([base, *flips]))


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_close_lanes(values, radius):
    values = np.array(values, np.uint64)
    others = values[::-1] ^ np.uint64(5)
    found = S.close_lanes(S.bit_planes(values), S.bit_planes(others), radius)
    want = np.flatnonzero(np.bitwise_count(values ^ others) <= radius)
    assert found[found < len(values)].tolist() == want.tolist()


def test_bucket_links():
    values = near_values(np.random.default_rng(1))
    assert (linked(len(values), *S.bucket_links(values)) == labels(values)).all()
    split = len(values) // 3
    side = np.arange(len(values)) < split
    child, root = S.bucket_links(values, split)
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 3) & (side[:, None] != side[None, :])
    reach = np.arange(len(values))
    for _ in range(len(values)):
        reach = np.array([min(reach[i], reach[near[i]].min() if near[i].any() else reach[i]) for i in range(len(values))])
    assert (linked(len(values), child, root) == reach).all()


def test_group_links():
    rng = np.random.default_rng(2)
    values = near_values(rng)
    group = np.sort(rng.integers(0, 100, len(values)))
    assert (linked(len(values), *S.group_links(group, values)) == labels(values, group)).all()


def check(rows, got):
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got)
    prints = [brute_fingerprint(t) for _, t in rows]
    group = labels(prints)
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    assert got == sorted((repr(i), f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group))


def test_edges(edges, edge_rows):
    check([r[:2] for r in edge_rows], S.near_duplicates(edges).collect())


def test_documents_with_near_copies(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()]
    rows += [(1000 + i, t + " zusatz") for i, t in rows if t and len(t) > 3000]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.near_duplicates(frame).collect()
    check(rows, found)
    assert any(r.doc_id >= 1000 and r.component_id < 1000 for r in found)


@pytest.mark.parametrize("tile", [16, 4096])
def test_tiles_lose_no_link(spark, tile):
    """A bucket cut into many tiles gives the components of the whole bucket."""
    rng = np.random.default_rng(3)
    far = np.uint64(0xABCDEF)
    values = np.unique(np.concatenate([near_values(rng, 3, 40), far ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))]))
    marks = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in S.components(S.close_links(marks, tile)).collect()}
    got = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    want = labels(values)
    assert len(set(zip(got, want.tolist()))) == len(set(got)) == len(set(want.tolist()))


def test_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501)], "a long, b long")
    found = {r.node: r.root for r in S.components(chain).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500}


def test_empty(nothing):
    assert S.near_duplicates(nothing).collect() == []
    assert S.keep_first(nothing).collect() == []


def test_one_row_of_each_component_stays(edges):
    rows = S.keep_first(edges).collect()
    found = S.near_duplicates(edges).collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    assert len(set(labels(prints).tolist())) == len(prints)
    assert len(rows) == len(set(labels([int(r.fingerprint, 16) for r in found]).tolist()))
