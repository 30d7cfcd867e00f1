import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from millrace.llm import grammar as G

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  b", " a", "a ", "\n", "a \n b", "a\n b", "x  \n\n y", "it's don't I'll we're", "<|endoftext|> x",
    "a<|endoftext|>b", "naïve café — ü", "日本語 テスト", "1,000 22nd $5.00", "\t\ttab  x", "word's. \"q\"", "é", "end.\n",
    "a　 b", "x\x1c y", "don’t “q”", "u.\nVw x.\nYé\nz", "u\n\nv w\n", "u\n.v a\nb c\n1", "a.b c!d ?! ...", "MIXED Case wörter,", "́x ý", "a b c d",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_give_the_ids_of_whole_texts(tokenizer, docs):
    texts = ODD + [r.text for r in docs.select("text").collect()]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in G.WordEncoder(PATH).encode(texts)] == want


@given(st.text(st.sampled_from("ab é.'\n\t 1<|😀"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    encoder = G.WordEncoder(PATH) if not hasattr(test_any_text, "encoder") else test_any_text.encoder
    test_any_text.encoder = encoder
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pretokens_are_encoded_once(tokenizer):
    """Marks, line breaks and contractions beside a word do not make it another one."""
    cores, marks = ["anoush", "Tion", "süß", "42"], ["", ".", ",", "###", "'s", ".\n", "!!\n", "\n"]
    texts = [f"{a}{m}{b}{k} {a}{k}{c}" for a in cores for m in marks for b in cores for k in marks for c in cores]
    encoder = G.WordEncoder(PATH)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert len(encoder.known) == len({w for t in texts for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(t)})


BROAD = "aAéñßsrtmdvelЖΩאनि日あ1²½٣'’!—_́😀   \n\t\r\x00\x1c\x85\xa0\u2028\u3000\u200b\ufeff"


@given(st.lists(st.text(st.one_of(st.sampled_from(BROAD), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_texts_of_any_characters_side_by_side(texts):
    encoder = G.WordEncoder(PATH) if not hasattr(test_any_text, "encoder") else test_any_text.encoder
    test_any_text.encoder = encoder
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_slices_and_nulls(tokenizer):
    column = pa.array(["x y", None, "naïve  café\n", "", "it's", None, "'s<|endoftext|> z"])
    for kind in (pa.string(), pa.large_string()):
        for start in range(len(column) + 1):
            got = [x.tolist() for x in G.WordEncoder(PATH).encode(column.cast(kind).slice(start))]
            assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()[start:]]


@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_every_second_pair_of_a_run_is_skipped(ids):
    same, skipped = G._equal_pairs(np.array(ids, np.uint32))
    want, counted = [], -2
    for i in range(len(ids) - 1):
        if ids[i] == ids[i + 1]:
            want.append((i, counted == i - 1))
            counted = counted if want[-1][1] else i
    assert same.tolist() == [i for i, _ in want]
    assert skipped.tolist() == [i for i, late in want if late]


@given(st.lists(st.integers(0, 6), max_size=600), st.integers(0, 600), st.integers(0, 600))
@settings(max_examples=150, deadline=None)
def test_round_trip(ids, a, b):
    ids = np.array(ids, np.uint32)
    shard = G.compress(ids, least=2)
    assert (G.decode(shard) == ids).all()
    start, end = sorted((min(a, len(ids)), min(b, len(ids))))
    assert G.decode_range(shard, start, end).tolist() == ids[start:end].tolist()
    assert int(shard.spans(shard.sequence).sum()) == len(ids)


def test_frequent_pairs_become_rules():
    ids = np.tile(np.array([3, 1, 4, 1, 5, 9, 2, 6], np.uint32), 500)
    shard = G.compress(ids)
    assert len(shard.sequence) < len(ids) / 20
    assert shard.lengths.max() >= 8


@pytest.mark.parametrize("copies", [3, 5, 11])
def test_no_pair_that_pays_is_left(copies):
    """Few copies of a document amid ids that hardly repeat, a run and pairs of very different frequency."""
    rng = np.random.default_rng(copies)
    text = rng.integers(0, 40_000, 300)
    parts = [np.append(text, rng.integers(0, 40_000, 200)) for _ in range(copies)]
    ids = np.concatenate([*parts, np.full(37, 7), np.tile([1, 2], 900)]).astype(np.uint32)
    shard = G.compress(ids)
    assert (G.decode(shard) == ids).all()
    assert len(shard.sequence) < 210 * copies + 60
    pairs, last = {}, {}
    for i, pair in enumerate(zip(shard.sequence.tolist(), shard.sequence[1:].tolist())):
        if last.get(pair, -2) < i - 1:
            pairs[pair], last[pair] = pairs.get(pair, 0) + 1, i
    assert max(pairs.values()) < 3


def test_planes():
    values = np.array([0, 1, 255, 256, 65_535, 70_000, (1 << 24) - 1])
    assert G.from_planes(G.to_planes(values, 3), 3).tolist() == values.tolist()


def check(rows, got, tokenizer):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, G.END], "<u4") for _, t in rows]
    want = sorted((repr(i), len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


def test_edges(edges, edge_rows, tokenizer):
    check([r[:2] for r in edge_rows], G.store(edges, PATH).collect(), tokenizer)


def test_many_shards(spark, docs, tokenizer, tmp_path):
    path = str(tmp_path / "shards")
    G.write_shards(docs, path, PATH, shard_tokens=3000)
    assert spark.read.parquet(path).count() > 20
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(rows, G.read_documents(spark, path).collect(), tokenizer)


def test_empty(nothing):
    assert G.store(nothing, PATH).collect() == []


def test_forgetting_changes_nothing(tokenizer, docs, monkeypatch):
    monkeypatch.setattr(G, "REMEMBERED", 100)
    texts = [r.text for r in docs.select("text").limit(40).collect()]
    encoder = G.WordEncoder(PATH)
    for t in texts:
        assert encoder.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encoder.known) < 5000
