"""Token ids in Re-Pair compressed shards.

Documents are encoded in ascending order of their ids, each closed by an end id, and
cut into shards of about ``shard_tokens`` ids (one document at least). In a shard,
rounds replace frequent pairs of symbols by new symbols: a round counts pairs, takes
those that occur ``least`` times or more and at least 1 / BREADTH as often as the most
frequent, and where they overlap the more frequent one wins. The rounds end when no
pair has ``least`` uses. A shard stores the
rules, the expansion length of each, and the rest of the sequence, so any range of
ids is decoded without the others (``decode_range``).

File format: a Parquet table, one row per shard: part and shard number, document ids,
the first id position of each document and the end, ``base`` (ids below are
terminals, symbol base + k is rule k), rules in rounds, lengths, sequence. Symbols are
byte planes of little-endian unsigned integers.

Encoding splits all texts of a batch at once by the rule of a byte-level pre-tokenizer,
so each distinct pre-token is encoded once, whatever stands beside it.

Defined results: a null text is empty and has the end id only; rows without an id come
first; rows of equal ids are ordered by a hash of their text; repeated rows are
encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .common import Numbering, bounded_batches, process_memory, scratch_path

END = 2
SHARD_TOKENS = 1 << 20
# Uses from which on a rule saves more than it takes.
LEAST = 3
# A round takes pairs down to 1 / BREADTH of the most frequent.
BREADTH = 48
# Distinct pre-tokens a worker process remembers; when full it forgets the rarer half.
REMEMBERED = 1_000_000


# Grammar


@dataclass
class Shard:
    base: int
    rules: np.ndarray  # (k, 2)
    rounds: np.ndarray  # rules made in each round
    lengths: np.ndarray  # ids that each rule stands for
    sequence: np.ndarray

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids that each symbol stands for."""
        rule = symbols >= self.base
        return np.where(rule, self.lengths[np.where(rule, symbols - self.base, 0)] if len(self.lengths) else 1, 1)


def _winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which occurrences (ascending positions, rank of their pair) are taken: none overlaps another, higher ranks first."""
    chosen, alive = np.zeros(len(at), bool), np.ones(len(at), bool)
    touch = at[1:] == at[:-1] + 1
    for _ in range(2):
        now = np.where(alive, rank, -1)
        best = alive.copy()
        best[1:] &= ~touch | (now[1:] > now[:-1])
        best[:-1] &= ~touch | (now[:-1] > now[1:])
        chosen |= best
        alive &= ~best
        alive[1:] &= ~(touch & best[:-1])
        alive[:-1] &= ~(touch & best[1:])
    return chosen


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of pairs, and the pairs in it; sorted together with their places where 64 bits hold both."""
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    place, half = len(keys).bit_length(), int(low.max()).bit_length() if len(keys) else 0
    if not len(keys) or int(high.max()).bit_length() + half + place > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    joined = (((high << np.uint64(half)) | low) << np.uint64(place)) | np.arange(len(keys), dtype=np.uint64)
    joined.sort()
    order = (joined & np.uint64((1 << place) - 1)).astype(np.int64)
    return order, keys[order]


def _equal_pairs(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of one symbol, and those of them that do not count: every second one of a run."""
    same = np.flatnonzero(sequence[:-1] == sequence[1:])
    opens = np.flatnonzero(np.diff(same, prepend=-2) != 1)
    begins = np.repeat(same[opens], np.diff(np.append(opens, len(same))))
    return same, same[(same - begins) % 2 == 1]


def _frequent_pairs(sequence: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs with ``least`` or more occurrences that do not overlap themselves, and enough of the most frequent one's:
    positions in ascending order, the number of the pair at each, the pairs, their counts, and how many were enough."""
    left, right = sequence[:-1], sequence[1:]
    bits = max(10, min(20, len(sequence).bit_length()))
    slot = left * np.uint32(0x9E3779B1)
    slot ^= right * np.uint32(0x85EBCA6B)
    slot *= np.uint32(0xC2B2AE35)
    slot = (slot >> np.uint32(32 - bits)).astype(np.int64)
    total = np.bincount(slot, minlength=1 << bits)
    skipped = _equal_pairs(sequence)[1]
    need = max(least, int(total.max()) // BREADTH)
    while True:
        # a slot's total is no less than the count of any of its pairs
        likely = (total >= need)[slot]
        likely[skipped] = False
        at = np.flatnonzero(likely)
        keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
        order, ranged = _ordered(keys)
        opens = np.flatnonzero(np.append(True, ranged[1:] != ranged[:-1])) if len(at) else np.zeros(0, np.int64)
        count = np.diff(np.append(opens, len(at)))
        number = np.empty(len(at), np.int64)
        number[order] = np.repeat(np.arange(len(opens)), count)
        enough = count >= need
        if enough.any() or need == least:
            break
        need = least
    kept = enough[number] if len(at) else np.zeros(0, bool)
    return at[kept], number[kept], ranged[opens], count, need


def _recounted_pairs(sequence: np.ndarray, least: int, active: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_frequent_pairs`` where every pair with ``least`` occurrences lies at ``active`` positions or in a run of one symbol."""
    same, skipped = _equal_pairs(sequence)
    marked = np.zeros(len(sequence), bool)
    marked[active] = marked[same] = True
    marked[skipped] = marked[-1] = False
    at = np.flatnonzero(marked)
    keys = (sequence[at].astype(np.uint64) << np.uint64(32)) | sequence[at + 1]
    order, ranged = _ordered(keys)
    opens = np.flatnonzero(np.append(True, ranged[1:] != ranged[:-1])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.append(opens, len(at)))
    number = np.empty(len(at), np.int64)
    number[order] = np.repeat(np.arange(len(opens)), count)
    kept = (count >= least)[number] if len(at) else np.zeros(0, bool)
    return at[kept], number[kept], ranged[opens], count


def compress(ids: np.ndarray, *, rounds: int | None = None, least: int = LEAST) -> Shard:
    """The grammar of ``ids``; without ``rounds`` it ends when no pair has ``least`` uses."""
    sequence = ids.astype(np.uint32)  # a copy
    base = int(sequence.max()) + 1 if len(ids) else 1
    rules, made = [], []
    lengths = np.zeros(0, np.int64)
    # once a round took all pairs down to ``least`` uses, later ones arise beside replaced places only
    active: np.ndarray | None = None
    while len(sequence) > 1 and (rounds is None or len(made) < rounds):
        if active is None:
            at, number, pairs, count, need = _frequent_pairs(sequence, least)
        else:
            at, number, pairs, count = _recounted_pairs(sequence, least, active)
        if not len(at):
            break
        counted = at
        # no two pairs have the same rank, so the first one loses no use and every round makes a rule
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(pairs))
        chosen = _winners(at, rank[number])
        at, number = at[chosen], number[chosen]
        uses = np.bincount(number, minlength=len(pairs))
        used = np.flatnonzero(uses >= least)
        worth = uses[number] >= least
        at, number = at[worth], number[worth]
        symbol = np.zeros(len(pairs), np.uint32)
        symbol[used] = base + len(lengths) + np.arange(len(used), dtype=np.uint32)
        new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        span = np.where(new >= base, lengths[np.where(new >= base, new - base, 0)] if len(lengths) else 1, 1)
        lengths = np.concatenate([lengths, span.sum(axis=1)])
        rules.append(new)
        made.append(len(used))
        sequence[at] = symbol[number]
        stays = np.ones(len(sequence), bool)
        stays[at + 1] = False
        sequence = sequence[stays]
        if need == least:
            place = np.cumsum(stays) - 1
            fresh = place[at]
            # what is left of the pairs just counted, and both sides of every new symbol
            active = np.concatenate([place[counted[stays[counted]]], fresh, np.maximum(fresh - 1, 0)])
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return Shard(base, table, np.array(made, np.int64), lengths, sequence)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges (start, size) of ``flat``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _expander(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expansions of all symbols: a flat array with start and size per symbol."""
    flat = np.arange(shard.base, dtype=np.uint32)
    starts, sizes = np.arange(shard.base), np.ones(shard.base, np.int64)
    done = 0
    for n in shard.rounds.tolist():
        symbols = shard.rules[done : done + n].ravel()
        fresh = _gather(flat, starts[symbols], sizes[symbols])
        size = shard.lengths[done : done + n]
        starts = np.concatenate([starts, len(flat) + np.cumsum(size) - size])
        sizes = np.concatenate([sizes, size])
        flat = np.concatenate([flat, fresh])
        done += n
    return flat, starts, sizes


def decode(shard: Shard) -> np.ndarray:
    flat, starts, sizes = _expander(shard)
    return _gather(flat, starts[shard.sequence], sizes[shard.sequence])


def decode_range(shard: Shard, start: int, end: int) -> np.ndarray:
    """Ids ``start`` up to ``end``: only symbols that reach into the range are expanded."""
    ends = np.cumsum(shard.spans(shard.sequence))
    if not len(ends) or end <= start:
        return np.zeros(0, np.uint32)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left")
    out: list[int] = []
    for symbol in shard.sequence[first : last + 1].tolist():
        stack = [symbol]
        while stack:
            top = stack.pop()
            if top < shard.base:
                out.append(top)
            else:
                a, b = shard.rules[top - shard.base].tolist()
                stack += [b, a]
    before = int(ends[first - 1]) if first else 0
    return np.array(out[start - before : end - before], np.uint32)


# Byte planes


def to_planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel()


# Encoding


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts; distinct pre-tokens are encoded once while they are remembered."""

    # Kinds of characters that the splitter of a byte-level vocabulary tells apart, and one of each
    BLANK, PROBES = 0, {1: "a", 2: "1", 3: "!"}
    UNSEEN = 255
    # The splitter's contractions, without their apostrophe
    ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = _byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = np.full(0x110000, self.UNSEEN, np.uint8)
        self.known = Numbering()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.kinds_of(np.arange(128))

    def forget_rare(self) -> None:
        """Keep the half of the room that was used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        words = list(self.known)
        self.known = Numbering()
        self.known.numbers([words[i] for i in kept])
        self.known.pending = []
        held = self.sizes[kept]
        self.flat = _gather(self.flat, self.starts[kept], held)
        self.starts, self.sizes, self.uses = np.cumsum(held) - held, held, self.uses[kept] // 2

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point; for one not seen before the splitter is asked whether it stays with a probe."""
        for point in np.unique(points[self.kinds[points] == self.UNSEEN]).tolist():
            joins = (k for k, c in self.PROBES.items() if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(c + chr(point))) == 1)
            self.kinds[point] = next(joins, self.BLANK)
        return self.kinds[points]

    def split(self, column: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pre-tokens of all texts, one after the other, and the number of those before each text and at the end.

        A pre-token is a run of one kind of character with the single space before it, or a contraction. Of several
        blanks the last stands alone, or goes with what follows if it is a space; at the end of a text it does neither.
        """
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        first, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        if not size:
            return pa.array([], pa.string()), np.zeros(len(bounds), np.int64)
        raw, bounds = np.frombuffer(column.buffers()[2], np.uint8)[first : first + size], bounds - first
        begins, ends = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
        kind = self.kinds[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        width = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
        point = raw[lead] & (0xFF >> (width + 1))
        for k in (1, 2, 3):
            more = width > k
            point[more] = point[more] << 6 | raw[lead[more] + k] & 0x3F
        kind[lead] = self.kinds_of(point)
        for k in (1, 2, 3):
            kind[lead[width > k] + k] = kind[lead[width > k]]

        blank = kind == self.BLANK
        opens = np.ones(size + 1, bool)
        opens[1:-1] = (kind[1:] != kind[:-1]) & (raw[:-1] != 32)
        # the last of several blanks before something else: by bytes, then again where a blank has several bytes
        last = np.zeros(size, bool)
        last[:-1] = blank[:-1] & ~blank[1:]
        last[ends - 1] = False
        wide = lead[blank[lead]]
        stop = wide + width[blank[lead]]
        final = last[stop - 1]
        last[stop - 1] = False
        last[wide] = final
        opens[:-1] |= last
        opens[begins] = True

        quote = np.flatnonzero((raw == 39) & opens[:-1])
        room = ends[np.searchsorted(ends, quote, "right")] - quote
        after = np.append(raw, np.zeros(2, np.uint8))
        for ending in self.ENDINGS:
            hit = room > len(ending)
            for k, letter in enumerate(ending, 1):
                hit &= after[quote + k] == letter
            opens[quote[hit] + 1] = False
            opens[quote[hit] + 1 + len(ending)] = True

        at = np.flatnonzero(opens).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at + np.int32(first)), column.buffers()[2])
        return pieces, np.searchsorted(at, bounds)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Encode the pre-tokens seen for the first time."""
        raw = [w.encode() for w in self.known.pending]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))).tolist()
        spelled = self.letters[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.tokenizer.model.tokenize
        ids, counts = [], []
        for s, e in zip([0, *ends], ends):
            found = [t.id for t in tokenize(spelled[s:e])]
            ids += found
            counts.append(len(found))
        held = np.array(counts, np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(held) - held])
        self.sizes = np.concatenate([self.sizes, held])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(held), np.int64)])
        self.known.pending = []

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        column = pa.compute.fill_null(column, "")
        if not len(column):
            return []
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        # pre-tokens are found and numbered in arrays; only distinct ones become Python strings
        pieces, bounds = self.split(column)
        coded = pieces.dictionary_encode()
        own = self.known.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if self.known.pending:
            self.learn()
        numbers = own[coded.indices.to_numpy()]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        # a text that spells a mark of the vocabulary's own goes through the tokenizer whole
        spells = np.zeros(len(column), bool)
        for mark in self.marks:
            spells |= pa.compute.match_substring(column, mark).to_numpy(zero_copy_only=False)
        direct = np.flatnonzero(spells).tolist()
        whole = dict(zip(direct, self.whole([column[i].as_py() for i in direct])))
        out = []
        for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if i in whole:
                out.append(np.array(whole[i], np.uint32))
            else:
                n = numbers[s:e]
                out.append(_gather(self.flat, self.starts[n], self.sizes[n]))
        return out


_SCHEMA = (
    "part int, shard int, doc_ids array<bigint>, starts array<bigint>, base long, rules binary, rounds array<bigint>, "
    "lengths binary, sequence binary"
)
_FIELDS = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
        ("base", pa.int64()), ("rules", pa.binary()), ("rounds", pa.list_(pa.int64())), ("lengths", pa.binary()),
        ("sequence", pa.binary()),
    ]
)


def write_shards(docs: DataFrame, path: str, tokenizer: str, *, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending order of doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = process_memory(f"words of {tokenizer}", lambda: WordEncoder(tokenizer))
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size, shard = 0, 0

        def closed() -> pa.RecordBatch:
            grammar = compress(np.concatenate(held))
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
            row = [
                part, shard, names, starts.tolist(), grammar.base, to_planes(grammar.rules.ravel(), 3),
                grammar.rounds.tolist(), to_planes(grammar.lengths, 4), to_planes(grammar.sequence, 3),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FIELDS)], schema=_FIELDS)

        for batch in bounded_batches(batches, chars=8_000_000):
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                held.append(np.append(ids, np.uint32(end)))
                names.append(name)
                size += len(ids) + 1
                if size >= shard_tokens:
                    yield closed()
                    held, names, size, shard = [], [], 0, shard + 1
        if held:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    )
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, _SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_of(row: dict) -> Shard:
    rules = from_planes(row["rules"], 3).reshape(-1, 2)
    return Shard(
        row["base"], rules, np.array(row["rounds"], np.int64), from_planes(row["lengths"], 4).astype(np.int64),
        from_planes(row["sequence"], 3),
    )


def read_documents(spark, path: str, digest: Callable[[bytes], int] = zlib.crc32) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards under ``path``."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                ids = memoryview(decode(shard_of(row)).astype("<u4").tobytes())
                starts = row["starts"]
                sums = [digest(ids[4 * s : 4 * e]) for s, e in zip(starts, starts[1:])]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(_SCHEMA).parquet(path)
    rows = shards.mapInArrow(expand, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # ids before a shard: those of earlier parts (one row per part), then those of earlier shards of the part
    sizes = shards.select("part", "shard", F.element_at("starts", -1).alias("n"))
    earlier = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier("part")), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    offsets = offsets.select("part", "shard", (F.col("before") + F.col("inside")).alias("offset"))
    return rows.join(offsets, ["part", "shard"]).select(
        "doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def store(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and read every document back from the files."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    write_shards(docs, path, tokenizer)
    return read_documents(spark, path)
