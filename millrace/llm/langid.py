"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a piece (a run of letters, lower-cased; longer
runs are cut every PIECE bytes) in both directions and gives every byte position a
distribution over languages. A document's probabilities are the mean over all its
positions. The state starts anew at each piece, so equal pieces give equal results
and each distinct piece of a batch is read once; whole texts are covered.

It is trained in numpy by backpropagation through time (Adam) on a bounded sample:
about ``docs_per_lang`` labelled documents of each language, chosen by hash, and
``words_per_doc`` consecutive words of each from a hashed start.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and
when there is nothing to learn from; rows without a language are not learned from;
repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Numbering, materialise, small_batches, text_slices, words

UNDETERMINED = "und"
PIECE = 48
HIDDEN = 16
DOCS_PER_LANG = 600
WORDS_PER_DOC = 120
# Distinct pieces a task remembers before it starts anew.
REMEMBERED = 300_000
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Network:
    """Weights of both directions: byte tables E (256, 3H), recurrences U (H, 3H), and the output layer."""

    langs: list[str]
    E: list[np.ndarray]
    U: list[np.ndarray]
    V: np.ndarray
    c: np.ndarray

    @property
    def hidden(self) -> int:
        return self.U[0].shape[0]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        langs,
        [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
        [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
        draw(2 * hidden, len(langs), scale=hidden**-0.5),
        np.zeros(len(langs), np.float32),
    )


def _run(E: np.ndarray, U: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over bytes x (B, T); with ``keep`` also what a backward pass needs."""
    n, steps, size = len(x), x.shape[1], U.shape[0]
    h = np.zeros((n, size), np.float32)
    states, tape = np.empty((steps, n, size), np.float32), []
    for t in range(steps):
        given, past = E[x[:, t]], h @ U
        gates = given[:, : 2 * size] + past[:, : 2 * size]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        update, reset = gates[:, :size], gates[:, size:]
        fresh = np.tanh(given[:, 2 * size :] + reset * past[:, 2 * size :])
        if keep:
            tape.append((h, update, reset, fresh, past[:, 2 * size :]))
        h = fresh + update * (h - fresh)
        states[t] = h
    return states, tape


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions (B, T) that read each row's first ``lengths`` bytes backwards, the rest in place."""
    at = np.arange(x.shape[1])[None, :]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return logits / logits.sum(axis=-1, keepdims=True)


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(B, T, C) for pieces of one length, bytes x (B, T)."""
    ahead, _ = _run(net.E[0], net.U[0], x, False)
    back, _ = _run(net.E[1], net.U[1], x[:, ::-1], False)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return _softmax(both @ net.V + net.c).transpose(1, 0, 2)


def gradients(net: Network, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy per position and its gradients (E, U of both directions, V, c)."""
    n, steps = x.shape
    size = net.hidden
    flip = _reversed(x, lengths)
    rows = np.arange(n)[:, None]
    inputs = [x, x[rows, flip]]
    states, tapes = zip(*(_run(net.E[d], net.U[d], inputs[d], True) for d in range(2)))
    # states of the second direction, put where their byte stands
    back = states[1].transpose(1, 0, 2)[rows, flip]
    both = np.concatenate([states[0].transpose(1, 0, 2), back], axis=2)
    probs = _softmax(both @ net.V + net.c)
    mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
    share = mask / mask.sum()
    loss = float(-(np.log(probs[rows, np.arange(steps)[None, :], y[:, None]] + 1e-12) * share).sum())
    error = probs.copy()
    error[rows, np.arange(steps)[None, :], y[:, None]] -= 1
    error *= share[:, :, None]
    flat = error.reshape(-1, error.shape[2])
    out = [both.reshape(-1, 2 * size).T @ flat, flat.sum(axis=0)]
    down = error @ net.V.T
    downs = [down[:, :, :size], down[:, :, size:][rows, flip]]
    tables, loops = [], []
    for d in range(2):
        E, U = net.E[d], net.U[d]
        dE, dU = np.zeros_like(E), np.zeros_like(U)
        dh = np.zeros((n, size), np.float32)
        for t in range(steps - 1, -1, -1):
            h, update, reset, fresh, past = tapes[d][t]
            dh = dh + downs[d][:, t]
            dfresh = dh * (1 - update) * (1 - fresh * fresh)
            dupdate = dh * (h - fresh) * update * (1 - update)
            dreset = dfresh * past * reset * (1 - reset)
            given = np.concatenate([dupdate, dreset, dfresh], axis=1)
            np.add.at(dE, inputs[d][:, t], given)
            passed = np.concatenate([dupdate, dreset, dfresh * reset], axis=1)
            dU += h.T @ passed
            dh = dh * update + passed @ U.T
        tables.append(dE)
        loops.append(dU)
    return loss, [*tables, *loops, *out]


def fit(pieces: list[bytes], labels: np.ndarray, langs: list[str], *, steps: int = 300, batch: int = 384, seed: int = 11) -> Network:
    """Train on pieces with label numbers; every language fills an equal share of a batch."""
    net, rng = new_network(langs), np.random.default_rng(seed)
    weights = [*net.E, *net.U, net.V, net.c]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    pools = [np.flatnonzero(labels == k) for k in range(len(langs))]
    pools = [p for p in pools if len(p)]
    each = max(1, batch // len(pools))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(p, each) for p in pools])
        lengths = np.array([len(pieces[i]) for i in chosen])
        x = np.zeros((len(chosen), int(lengths.max())), np.int64)
        for row, i in enumerate(chosen):
            x[row, : lengths[row]] = np.frombuffer(pieces[i], np.uint8)
        _, grads = gradients(net, x, lengths, labels[chosen])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = 0.01 * min(1.0, 2.0 - 2.0 * step / (steps + 1))
        clip = 1.0 / max(1.0, norm)
        for w, g, m, v in zip(weights, grads, first, second):
            g = g * clip
            m += 0.1 * (g - m)
            v += 0.005 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)
    return net


def pieces_of(run: str) -> list[bytes]:
    """The letters of a run as pieces of at most PIECE bytes."""
    if not run.isalpha():
        run = "".join(c for c in run if c.isalpha())
    raw = run.encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def piece_sums(net: Network, pieces: list[bytes]) -> np.ndarray:
    """Sum over positions of the probabilities of each piece (n, C)."""
    out = np.zeros((len(pieces), len(net.langs)), np.float32)
    lengths = np.array([len(p) for p in pieces])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        for at in range(0, len(own), 8192):
            some = own[at : at + 8192]
            x = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8).reshape(len(some), length)
            out[some] = position_probabilities(net, x).sum(axis=1)
    return out


class Reader:
    """Document probabilities; remembers the distinct runs it has read."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.known = Numbering()
        self.sums = np.zeros((0, len(self.net.langs)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def learn(self) -> None:
        """Read the runs seen for the first time."""
        runs = self.known.pending
        cut = [pieces_of(r) for r in runs]
        flat = [p for ps in cut for p in ps]
        owner = np.repeat(np.arange(len(runs)), [len(ps) for ps in cut])
        sums = np.zeros((len(runs), len(self.net.langs)), np.float32)
        np.add.at(sums, owner, piece_sums(self.net, flat))
        sizes = np.bincount(owner, [len(p) for p in flat], len(runs)).astype(np.int64)
        self.sums = np.concatenate([self.sums, sums])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.known.pending = []

    def read(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over positions (n, C); zeros where a text has no letter."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found = [self.known.numbers(LETTERS.findall(t.lower())) for t in texts]
        if self.known.pending:
            self.learn()
        out = np.zeros((len(texts), len(self.net.langs)))
        for row, at in enumerate(found):
            positions = self.sizes[at].sum()
            if positions:
                out[row] = self.sums[at].sum(axis=0, dtype=np.float64) / positions
        return out


def label_positions(net: Network, text: str) -> list[tuple[int, int, str]]:
    """Runs (start, end, language) over the UTF-8 bytes of the lower-cased text that belong to letters."""
    spans: list[tuple[int, int, str]] = []
    lowered = text.lower()
    offset, done = 0, 0
    for match in LETTERS.finditer(lowered):
        offset += len(lowered[done : match.start()].encode("utf-8", "surrogatepass"))
        done = match.start()
        at = offset
        for piece in pieces_of(match.group()):
            best = position_probabilities(net, np.frombuffer(piece, np.uint8)[None, :])[0].argmax(axis=1)
            for k in best:
                if spans and spans[-1][1] == at and spans[-1][2] == net.langs[k]:
                    spans[-1] = (spans[-1][0], at + 1, net.langs[k])
                else:
                    spans.append((at, at + 1, net.langs[k]))
                at += 1
    return spans


def train(docs: DataFrame, learnable: Column, *, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC) -> Network | None:
    """A network from the rows of ``docs`` (text, lang) that are ``learnable`` and have a language."""
    own = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # hashed shares, so the sample has about docs_per_lang rows of each language at any size
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    shares = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, docs_per_lang / n) * (1 << 30))))])
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.size("w") - words_per_doc, F.lit(0)) + 1).cast("int") + 1
    sample = (
        own.where(draw < shares[F.col("lang")])
        .select("lang", "text", words(F.col("text")).alias("w"))
        .select("lang", F.array_join(F.slice("w", start, words_per_doc), " ").alias("text"))
        .limit(2 * docs_per_lang * len(counts))
        .collect()
    )
    langs = sorted(counts)
    pieces, labels = [], []
    for row in sorted(sample, key=lambda r: (r["lang"], r["text"])):
        own_pieces = [p for run in LETTERS.findall(row["text"].lower()) for p in pieces_of(run)]
        pieces += own_pieces
        labels += [langs.index(row["lang"])] * len(own_pieces)
    return fit(pieces, np.array(labels), langs) if pieces else None


def reading(net: Network | None, text: Column) -> Column:
    """A struct (lang, score) of the language of ``text``; only the text goes to Python."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(net) if net is not None else None
        for batch in batches:
            langs, scores = [], []
            for texts in text_slices(batch.tolist()):
                probs = reader.read(texts) if reader else np.zeros((len(texts), 1))
                best, top = probs.argmax(axis=1), np.minimum(probs.max(axis=1), 1.0)
                langs += [net.langs[k] if net and s > 0 else UNDETERMINED for k, s in zip(best.tolist(), top.tolist())]
                scores += top.tolist()
            yield pd.DataFrame({"lang": langs, "score": scores})

    # not to be evaluated again for a filter on its result
    return F.pandas_udf(read, "lang string, score double").asNondeterministic()(text)


def identify(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, lang_pred and score."""
    own = docs.select(*keep, reading(net, F.col("text")).alias("__mr_read"))
    with small_batches(docs.sparkSession):
        read = materialise(own, "languages")
    return read.select(*keep, F.col("__mr_read.lang").alias("lang_pred"), F.col("__mr_read.score").alias("score"))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds a letter, by the text alone."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([LETTERS.search((t or "").lower()) is not None for t in batch.tolist()], dtype=bool)

    with small_batches(docs.sparkSession):
        return materialise(docs.where(F.pandas_udf(read, "boolean")(F.col("text"))), "with_letters")


def keep_identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, a missing ``lang`` filled in; all if nothing was learned."""
    if net is None:
        return docs
    read = docs.withColumn("__mr_read", reading(net, F.col("text"))).where(F.col("__mr_read.lang") != UNDETERMINED)
    with small_batches(docs.sparkSession):
        return materialise(read.withColumn("lang", F.coalesce("lang", "__mr_read.lang")).drop("__mr_read"), "identified")
