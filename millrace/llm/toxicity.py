"""Toxicity of deobfuscated text: noisy-channel decoding, then a word model.

A character trigram model counts the letters of all texts (each task folds its own
counts; what reaches the driver is one table of 27 ** 3 cells). Tokens that may be
disguised become lattices: leetspeak and wildcard symbols may stand for letters,
separators inside a token or between single characters may be nothing or a word
end, and repeated letters may be one or two. The Viterbi path under the character
model and the channel costs is the restored text. Other tokens have one path only,
themselves, and skip the search. Texts are composed (NFC) first and accents of Latin
letters dropped; letters and marks of other scripts pass the search as they are, the
character model knows a to z only. Symbols stand for Latin letters.

From a bounded, hash-chosen sample of labelled rows (``sample_rows``; texts that
share a fingerprint count once) words and word beginnings are taken whose link with
the label is significant after a Bonferroni correction; beginnings serve languages
that inflect and compound. Each distinct word of a document counts with the largest
log odds among those it matches; a logistic curve over the root of their sum, fitted
to the sample, gives the score. Whole texts are scored.

Defined results: null and empty texts hold no evidence and get the score of a text
without any; without labelled rows, or labels of one kind only, every row gets the
smoothed share of label 1 (0.5 without any); repeated rows get equal scores; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_slices, materialise
from .quality_gbt import labelled_sample
from .simhash import fingerprint, shingle_hashes

SAMPLE_ROWS = 40_000
# Distinct tokens a task remembers before it starts anew.
REMEMBERED = 400_000

# Letters that a symbol or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i",
}
# Symbols that may hide any letter.
WILD = "*#%?"
# Symbols that may separate the letters of one word.
SEPARATORS = ".-_*~^'`,:;/\\|+=#!&"
EDGE = ".,;:!?\"'()[]{}<>…|*#%&~^_-=+/\\`“”‘’«»¿¡"

# Lengths of the word beginnings that are features beside whole words; they carry a mark.
STEMS = range(4, 11)
STEM = "*"

# Channel costs (natural logs).
COST_LEET, COST_WILD, COST_SKIP, COST_END, COST_ONCE, COST_TWICE, COST_LITERAL = -0.7, -3.5, -1.0, -3.0, -0.3, -0.6, -8.0
_NUMBER = re.compile(r"[0-9]+(?:[.,:/-][0-9]+)*")
_RUN = re.compile(r"(.)\1\1")
_DECORATION = re.compile(r"^[$@]{3,}|[$@]{3,}$")


def _letter_codes() -> np.ndarray:
    """Code point to letter: 1 to 26 for a to z with case and accents removed, else 0 (a boundary)."""
    table = np.zeros(0x250, np.int64)
    for point in range(len(table)):
        plain = unicodedata.normalize("NFKD", chr(point).lower())[:1].lower()
        if chr(point).isalpha() and "a" <= plain <= "z":
            table[point] = ord(plain) - 96
    return table


CODES = _letter_codes()
FOLD = {point: chr(96 + code) for point, code in enumerate(CODES.tolist()) if code}


# Accents that no composed letter holds, such as strokes through the letters.
_ACCENTS = re.compile("(?<=[A-Za-z\u00c0-\u024f])[\u0300-\u036f]+")


def composed(text: str) -> str:
    """``text`` in composed form, Latin letters without further accents."""
    return text if text.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFC", text))


def folded(token: str) -> str:
    """A token in lower case, Latin letters without accents."""
    return composed(token).translate(FOLD).lower()


def is_other(c: str) -> bool:
    """Whether ``c`` is a letter or mark that the character model does not know."""
    return not c.isascii() and (c.isalpha() or unicodedata.category(c)[0] == "M")


def letter_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], 0)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts (27 ** 3) of letter trigrams; words begin after two boundaries and end with one."""
    codes = letter_codes("  " + "  ".join(map(composed, texts)) + " ")
    # one boundary is enough to end a word, two begin the next
    codes = codes[np.append(True, (codes[1:] > 0) | (codes[:-1] > 0))]
    opens = np.flatnonzero((codes[:-1] == 0) & (codes[1:] > 0)) + 1
    codes = np.insert(codes, opens, 0)
    return np.bincount(codes[:-2] * 729 + codes[1:-1] * 27 + codes[2:], minlength=27**3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Smoothed log probabilities (27, 27, 27) of a letter after two, from all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for _, texts in bounded_slices(batches):
            total += trigram_counts(texts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    folded = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(27**3)
    for row in folded.collect():
        counts[row["gram"]] = row["n"]
    return smoothed(counts.reshape(27, 27, 27))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Trigram estimates that fall back on bigrams and letters where they have seen little."""
    letters = counts.sum(axis=(0, 1)) + 1.0
    one = letters / letters.sum()
    pairs = counts.sum(axis=0)
    two = (pairs + 20.0 * one) / (pairs.sum(axis=1, keepdims=True) + 20.0)
    three = (counts + 5.0 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5.0)
    return np.log(three)


Readings = tuple[tuple[str, float], ...]


@lru_cache(maxsize=4096)
def _letter_readings(c: str, n: int) -> Readings:
    """Readings of ``n`` times the letter ``c`` (3: three or more)."""
    if "a" <= c <= "z":
        return ((c, 0.0),) if n == 1 else ((c, COST_ONCE if n > 2 else -1.5), (c * 2, COST_TWICE if n > 2 else 0.0))
    return ((c * n, 0.0),) if n < 3 else ((c, COST_ONCE), (c * 2, COST_TWICE))


@lru_cache(maxsize=4096)
def _mark_readings(c: str) -> Readings:
    readings = [(letter, COST_LEET) for letter in LEET.get(c, "")]
    if c in WILD:
        readings += [(chr(97 + k), COST_WILD) for k in range(26)]
    if c in SEPARATORS:
        readings.append(("", COST_SKIP))
    if c == " ":
        readings.append(("", -0.5))
    # a digit or symbol that stands for itself is as rare as it is costly
    literal = c in LEET and c not in SEPARATORS
    readings.append((" ", -0.5 if c == " " else COST_LITERAL if literal else COST_END))
    return tuple(readings)


def lattice(token: str) -> list[Readings]:
    """Per position the readings (letters, cost); an empty reading skips, a blank ends a word.

    A blank in ``token`` separates single characters that may belong together. Equal
    positions share one tuple of readings.
    """
    steps: list[Readings] = []
    i = 0
    while i < len(token):
        c = token[i]
        if not ("a" <= c <= "z" or is_other(c)):
            steps.append(_mark_readings(c))
            i += 1
            continue
        run = i
        while run < len(token) and token[run] == c:
            run += 1
        if c.isalpha():
            steps.append(_letter_readings(c, min(run - i, 3)))
        else:
            steps.append(((c * (run - i), 0.0),))
        i = run
    return steps


# Positions whose back pointers are held at a time; those of earlier ones are worked out again.
BLOCK = 4096
# Longer lattices, and those of several wildcards, are searched with arrays over all 27 x 27 states.
SHORT = 200


def _reached(state: int, letters: str, score: float, model: list[list[list[float]]]) -> tuple[int, float]:
    """State (last two letters, 0: boundary) and score after a reading."""
    p, q = divmod(state, 27)
    for letter in letters:
        if letter == " ":
            if q:
                score += model[p][q][0]
            p = q = 0
        elif letter > "z":
            # of a script the model does not know: no cost, and a new beginning for the model
            p = q = 0
        else:
            k = ord(letter) - 96
            score += model[p][q][k]
            p, q = q, k
    return 27 * p + q, score


def _search_few(steps: list[Readings], model: list[list[list[float]]]) -> list[int]:
    """The best reading of every position, following only the states that occur."""
    states = {0: 0.0}
    backs: list[dict[int, tuple[int, int]]] = []
    for readings in steps:
        after: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        ordered = sorted(states.items())
        for r, (letters, cost) in enumerate(readings):
            for state, score in ordered:
                to, now = _reached(state, letters, score + cost, model)
                if to not in after or now > after[to]:
                    after[to], back[to] = now, (r, state)
        states = after
        backs.append(back)
    state = max(sorted(states), key=lambda s: _reached(s, " ", states[s], model)[1])
    chosen = []
    for back in reversed(backs):
        r, state = back[state]
        chosen.append(r)
    return chosen[::-1]


def _search_arrays(steps: list[Readings], model: np.ndarray) -> list[int]:
    """As ``_search_few`` with arrays over all states; time and memory per position are fixed.

    Back pointers (reading and state before) are held for one block; at the edges
    of blocks the scores are kept, and the way back works a block out again.
    """
    here = np.arange(27)
    every = np.arange(729).reshape(27, 27)
    # what ends a word: no cost at a boundary
    ends = np.where(here[None] > 0, model[:, :, 0], 0.0)

    @lru_cache(maxsize=None)
    def moves(readings: Readings) -> list:
        """Readings by kind: those of one letter and one cost go together."""
        out: list = []
        for r, (letters, cost) in enumerate(readings):
            k = ord(letters) - 96 if len(letters) == 1 and "a" <= letters <= "z" else -1
            if k > 0 and out and out[-1][0] == "letters" and out[-1][2] == cost:
                out[-1][1].append(k)
                out[-1][3].append(r)
            elif k > 0:
                out.append(["letters", [k], cost, [r]])
            elif not letters:
                out.append(["skip", None, cost, r])
            elif "a" <= letters[0] <= "z":
                k = ord(letters[0]) - 96
                out.append(["twice", k, cost, r])
            else:
                out.append(["end", letters == " ", cost, r])
        for move in out:
            if move[0] == "letters":
                ks = move[1]
                every_letter = ks == list(range(1, 27))
                move[1] = slice(1, 27) if every_letter else np.array(ks)
                move[3] = np.array(move[3])
                move.append(np.ascontiguousarray(model[:, :, move[1]]))
        return out

    def forward(score: np.ndarray, part: list[Readings], back: np.ndarray) -> np.ndarray:
        for i, readings in enumerate(part):
            after = np.full((27, 27), -np.inf)
            reading = np.zeros((27, 27), np.int32)
            before = np.zeros((27, 27), np.int32)
            for kind, what, cost, r, *rest in moves(readings):
                now = score + cost
                if kind == "skip":
                    better = now > after
                    np.copyto(after, now, where=better)
                    np.copyto(reading, r, where=better)
                    np.copyto(before, every, where=better)
                elif kind == "end":
                    full = (now + ends if what else now).ravel()
                    at = int(full.argmax())
                    if full[at] > after[0, 0]:
                        after[0, 0], reading[0, 0], before[0, 0] = full[at], r, at
                elif kind == "twice":
                    full = (now + model[:, :, what] + model[:, what, what][None]).ravel()
                    at = int(full.argmax())
                    if full[at] > after[what, what]:
                        after[what, what], reading[what, what], before[what, what] = full[at], r, at
                else:
                    # [first, second, letter]: the best first letter for every (second, letter)
                    full = now[:, :, None] + rest[0]
                    first, top = full.argmax(axis=0), full.max(axis=0)
                    held = after[:, what]
                    better = top > held
                    after[:, what] = np.where(better, top, held)
                    reading[:, what] = np.where(better, r, reading[:, what])
                    before[:, what] = np.where(better, 27 * first + here[:, None], before[:, what])
            back[i] = (729 * reading + before).ravel()
            score = after
        return score

    edges = [np.full((27, 27), -np.inf)]
    edges[0][0, 0] = 0.0
    blocks = [steps[at : at + BLOCK] for at in range(0, len(steps), BLOCK)]
    back = np.zeros((min(len(steps), BLOCK), 729), np.int32)
    for part in blocks:
        edges.append(forward(edges[-1], part, back))
    state = int((edges[-1] + ends).argmax())
    chosen = []
    for k in range(len(blocks) - 1, -1, -1):
        if k < len(blocks) - 1:
            forward(edges[k], blocks[k], back)
        for row in back[: len(blocks[k])][::-1]:
            r, state = divmod(int(row[state]), 729)
            chosen.append(r)
    return chosen[::-1]


def decode(token: str, model: list[list[list[float]]], arrays: np.ndarray | None = None) -> str:
    """The most probable reading of a lower-cased, folded token under the character model.

    Both searches keep, of equally probable ways to a state, the one with the earliest
    reading, then that from the first state. ``arrays`` is the model as an array, where at hand.
    """
    steps = lattice(token)
    many = len(steps) > SHORT or sum(c in WILD for c in token) > 1
    if many:
        chosen = _search_arrays(steps, np.array(model) if arrays is None else arrays)
    else:
        chosen = _search_few(steps, model)
    return "".join(readings[r][0] for readings, r in zip(steps, chosen)).strip()


def core_of(token: str) -> str:
    """A token in lower case and without accents and outer punctuation; up to two outer $ or @ may be letters."""
    return _DECORATION.sub("", folded(token).strip(EDGE)).strip(EDGE)


@dataclass
class Restorer:
    """Restored words of tokens and of runs of single characters."""

    model: list[list[list[float]]]
    # collapsed forms of words of interest, so that doubled letters are looked into as well
    wanted: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.arrays = np.array(self.model)
        self.beginnings = {w[:k] for w in self.wanted for k in range(1, len(w) + 1)}

    def words(self, token: str) -> list[str]:
        core = core_of(token)
        if not core:
            return []
        if core.isalpha() or all("a" <= c <= "z" or is_other(c) for c in core):
            if not _RUN.search(core) and not (self.wanted and collapsed(core) in self.wanted):
                return [core]
        elif not any(c.isalpha() for c in core):
            return self.hidden(core)
        return decode(core, self.model, self.arrays).split()

    def run_words(self, joined: str) -> list[str]:
        """Words of a run of single characters, parted by blanks; a run without a letter is one wanted word or nothing."""
        if any(c.isalpha() for c in joined):
            return decode(joined, self.model, self.arrays).split()
        return [] if joined.replace(" ", "").isdecimal() else self.hidden(joined)

    def hidden(self, core: str) -> list[str]:
        """The most probable reading of a core without a letter as one wanted word; plain numbers are what they are."""
        if not self.wanted or _NUMBER.fullmatch(core) or not any(c in LEET for c in core):
            return []
        # only beginnings of wanted words are followed
        held = {"": 0.0}
        for readings in lattice(core):
            after: dict[str, float] = {}
            for text, score in held.items():
                for letters, cost in readings:
                    # a letter counts twice in a row at most, so what is held is bounded by the wanted words
                    out = text if text[-2:] == letters * 2 != "" else text + letters
                    if letters == " " or (out and collapsed(out) not in self.beginnings):
                        continue
                    after[out] = max(after.get(out, -math.inf), score + cost)
            held = after
            if not held:
                return []
        found = [(score, word) for word, score in held.items() if collapsed(word) in self.wanted]
        return [max(found)[1]] if found else []


def collapsed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def single(token: str) -> str:
    """The character of a token that is one letter or disguised letter, else empty."""
    core = folded(token).strip(".,;:-_\"'()[]") or token[:1]
    return core if len(core) == 1 and ("a" <= core <= "z" or core in LEET or core in WILD) else ""


def single_runs(flags: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Ranges of at least ``least`` set flags in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(s, e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - s >= least]


@dataclass
class WordModel:
    """Log odds of words and (marked) word beginnings, and the logistic curve over the evidence."""

    weights: dict[str, float]
    base: float
    slope: float

    def of(self, word: str) -> float:
        """The largest log odds of the word and its beginnings; 0 without any."""
        found = [self.weights.get(word, 0.0)]
        found += [self.weights.get(word[:k] + STEM, 0.0) for k in STEMS if k < len(word)]
        return max(found)

    def disguised(self) -> set[str]:
        """Whole words without doubled letters, for a look into tokens with doubled letters."""
        return {collapsed(w) for w in self.weights if not w.endswith(STEM)}

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.base + self.slope * np.sqrt(evidence), -30, 30)))


class TextReader:
    """Evidence of texts; remembers the distinct tokens it has restored."""

    SINGLE, NOTHING = -2, -1

    def __init__(self, restorer: Restorer, learned: WordModel):
        self.restorer, self.learned = restorer, learned
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.runs: dict[bytes, list[int]] = {}
        self.several: list[list[int]] = []
        self.number: dict[str, int] = {}
        self.values: list[float] = []

    def numbers(self, words: list[str]) -> list[int]:
        """Numbers of the words that are evidence."""
        out = []
        for word in words:
            if word not in self.number:
                value = self.learned.of(word)
                self.number[word] = len(self.values) if value > 0 else self.NOTHING
                if value > 0:
                    self.values.append(value)
            if self.number[word] != self.NOTHING:
                out.append(self.number[word])
        return sorted(set(out))

    def of(self, token: str) -> int:
        """A word's number; below SINGLE a list of several; SINGLE for single characters."""
        if single(token):
            return self.SINGLE
        words = self.restorer.words(token)
        if len(words) == 1 and not self.learned.of(words[0]):
            return self.NOTHING
        found = self.numbers(words)
        if len(found) < 2:
            return found[0] if found else self.NOTHING
        self.several.append(found)
        return self.SINGLE - len(self.several)

    def of_run(self, joined: str) -> list[int]:
        """Numbers of the words of a run of single characters; runs are remembered by digest, as they may be long."""
        key = hashlib.blake2b(joined.encode(), digest_size=16).digest()
        if key not in self.runs:
            self.runs[key] = self.numbers(self.restorer.run_words(joined))
        return self.runs[key]

    def evidence(self, text: str) -> float:
        """Sum over the distinct words of a text."""
        if len(self.known) + len(self.runs) > REMEMBERED:
            self.forget()
        tokens = text.split()
        known = self.known
        try:
            ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = self.of(t)
            ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        special = np.unique(ids[ids != self.NOTHING]).tolist()
        out = {k for k in special if k >= 0}
        for k in special:
            if k < self.SINGLE:
                out.update(self.several[self.SINGLE - k - 1])
        if self.SINGLE in special:
            for s, e in single_runs(ids == self.SINGLE):
                out.update(self.of_run(" ".join(map(single, tokens[s:e]))))
        # in the order of values: the sum does not depend on what was read before
        return math.fsum(self.values[k] for k in out)


def restored_words(text: str, restorer: Restorer, memory: dict[str, list[str]]) -> set[str]:
    """All distinct words of a text after restoration."""
    tokens = text.split()
    out: set[str] = set()
    for t in set(tokens):
        if t not in memory:
            memory[t] = restorer.words(t)
        out.update(memory[t])
    flags = np.fromiter((bool(single(t)) if len(t) < 6 else False for t in tokens), bool, len(tokens))
    for s, e in single_runs(flags):
        out.update(restorer.run_words(" ".join(map(single, tokens[s:e]))))
    return out


def restore(text: str, restorer: Restorer) -> str:
    """The restored text: words in order, parted by single blanks."""
    tokens = text.split()
    flags = np.fromiter((bool(single(t)) for t in tokens), bool, len(tokens))
    runs = {s: e for s, e in single_runs(flags)}
    out, i = [], 0
    while i < len(tokens):
        if i in runs:
            out += restorer.run_words(" ".join(map(single, tokens[i : runs[i]])))
            i = runs[i]
        else:
            out += restorer.words(tokens[i])
            i += 1
    return " ".join(w for w in out if w)


def features(words: Column) -> Column:
    """The distinct words and marked word beginnings of a list of words."""

    def of(word: Column) -> Column:
        longest = F.least(F.length(word) - 1, F.lit(STEMS[-1]))
        stems = F.when(
            longest >= STEMS[0],
            F.transform(F.sequence(F.lit(STEMS[0]), longest), lambda k: F.concat(F.substring(word, 1, k), F.lit(STEM))),
        ).otherwise(F.array().cast("array<string>"))
        return F.array_append(stems, word)

    return F.array_distinct(F.flatten(F.transform(words, lambda w: of(w))))


def association(toxic: int, clean: int) -> tuple[Column, Column]:
    """The likelihood ratio of presence against label, and the log odds, of a word in a and b texts of each label."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n, held = float(toxic + clean), F.col("a").cast("double") + F.col("b").cast("double")

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = 2 * (
        part(a, held * (toxic / n))
        + part(b, held * (clean / n))
        + part(toxic - a, (n - held) * (toxic / n))
        + part(clean - b, (n - held) * (clean / n))
    )
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    return ratio, odds


def choose_words(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Log odds of the words (word, a, b) found significantly more often with label 1.

    The ratio must exceed what chance gives to the best of as many words as were seen
    at least twice. Only the chosen words reach the driver.
    """
    tested = max(2, counts.where("a + b > 1").count())
    ratio, odds = association(toxic, clean)
    more_often = (F.col("a") >= 2) & (F.col("a") * clean > F.col("b") * toxic)
    chosen = counts.where(more_often & (ratio > 2.0 * math.log(tested / 0.05))).select("word", odds.alias("odds"))
    return {r["word"]: r["odds"] for r in chosen.collect()}


def fit_curve(evidence: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Base and slope of a logistic curve over the root of the evidence by Newton steps, the slope lightly shrunk."""
    x = np.stack([np.ones(len(y)), np.sqrt(evidence)], axis=1)
    w = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    prior = np.array([1e-6, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + prior * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(prior), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, learnable: Column, model: np.ndarray, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> WordModel:
    grams = model.tolist()
    sample = labelled_sample(docs, labels, label, learnable, sample_rows).select("text", "__mr_y")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = Restorer(grams), {}
        for part, texts in bounded_slices(batches):
            prints = [fingerprint(shingle_hashes(t)) for t in texts]
            lists = []
            for t in texts:
                lists.append(sorted(restored_words(t, restorer, memory)))
                if len(memory) > REMEMBERED:
                    memory = {}
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(lists, pa.list_(pa.string()))],
                ["y", "fp", "words"],
            )

    # copies count once: of equal fingerprints and labels one row stays
    read = sample.mapInArrow(marks, "y int, fp long, words array<string>")
    read = materialise(read.groupBy("fp", "y").agg(F.min("words").alias("words")), "read")
    sizes = {r["y"]: r["n"] for r in read.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 1.0) / (toxic + clean + 2.0)
        return WordModel({}, math.log(share / (1 - share)), 0.0)
    counts = read.select("y", F.explode(features(F.col("words"))).alias("word")).groupBy("word")
    counts = materialise(counts.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")), "word_counts")
    learned = WordModel(choose_words(counts, toxic, clean), 0.0, 0.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [math.fsum(map(learned.of, words)) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], ["y", "evidence"])

    held = read.select("y", "words").mapInArrow(weigh, "y int, evidence double")
    rows = sorted((r["y"], r["evidence"], r["n"]) for r in held.groupBy("y", "evidence").agg(F.count(F.lit(1)).alias("n")).collect())
    y = np.repeat([r[0] for r in rows], [r[2] for r in rows]).astype(float)
    evidence = np.repeat([r[1] for r in rows], [r[2] for r in rows])
    return WordModel(learned.weights, *fit_curve(evidence, y))


def score(docs: DataFrame, model: np.ndarray, learned: WordModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, score and predicted."""
    own = docs.select(*[F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)], F.col("text").alias("__text"))
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    grams = model.tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TextReader(Restorer(grams, learned.disguised()), learned)
        for part, texts in bounded_slices(batches, "__text"):
            evidence = np.array([reader.evidence(t) for t in texts])
            p = learned.probability(evidence)
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return own.mapInArrow(read, schema)
