"""SimHash near-duplicates: bit-sliced comparison of fingerprints, linked components.

Fingerprints are compared only where they can be close. With radius 3, two of them
agree in at least one of four 16-bit blocks; their other 48 bits, cut into four
12-bit parts, again agree in at least one. So 16 keys of 28 bits lead every close
pair to a shared bucket, at any size. Inside a bucket fingerprints are stored as
vertical bit planes: one word operation advances 64 distances at once, kept in
carry-save counters, and a block is abandoned once all its distances exceed the
radius. A bucket with more than ``tile`` fingerprints is dealt out as pairs of
tiles, so one task holds two tiles at most. A bucket emits a spanning forest of its
links, not all pairs; components follow by alternating star contraction.

Defined results: null texts count as empty; texts without a word have fingerprint
zero and are linked like any other; null ids never become a component's id (a
component of null ids only has a null ``component_id``); repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import empty_like, materialise, skew_join, small_batches, text_slices
from .exact_stream import keep_rows, normalised

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE = 8192
# Groups up to this size are compared as lanes of neighbours, larger ones as blocks.
SMALL = 48
# Queries compared with a large bucket at once.
QUERIES = 64
MAX_TILES = 46_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``width`` words, joined by one space, repeats included."""
    joined = b" ".join(_SPACE.split(text.encode("utf-8", "surrogatepass").translate(LOWER))).strip(b" ")
    if not joined:
        return []
    digest = xxhash.xxh64_intdigest
    ends = [i for i, c in enumerate(joined) if c == 32] if len(joined) < 64 else np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    if len(ends) < width:
        return [digest(joined, SEED)]
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(joined))
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is set if it is set in over half of ``hashes``; zero for none."""
    if not hashes:
        return 0
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(len(hashes), 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 15):
        votes += np.unpackbits(raw[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def marking(text: Column) -> Column:
    """The fingerprint of ``text`` as a signed long; only the text goes to Python."""

    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            marks = [fingerprint(shingle_hashes(t)) for texts in text_slices(batch.tolist()) for t in texts]
            yield pd.Series(np.array(marks, np.uint64).view(np.int64))

    return F.pandas_udf(mark, "long")(text)


# Bit-sliced comparison


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed words: bit k of word w of row b is bit b of ``values[64 * w + k]``."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8"))


def _close(diff: Callable[[int, np.ndarray | None], np.ndarray], width: int, radius: int) -> np.ndarray:
    """Packed flags of the lanes in ``width`` words whose distance is at most ``radius`` (below 8).

    ``diff(bit, live)`` gives the words in which lanes differ in a bit, for the words
    ``live`` (None: all). The counters are three bit planes per lane plus a sticky
    overflow. A word whose 64 lanes have all exceeded the radius takes no part in the
    remaining bits.
    """
    out = np.zeros(width, np.uint64)
    live: np.ndarray | None = None
    ones, twos, fours, over = (np.zeros(width, np.uint64) for _ in range(4))
    for b in range(64):
        carry = diff(b, live)
        for plane in (ones, twos, fours):
            further = plane & carry
            plane ^= carry
            carry = further
        over |= carry
        if b % 8 == 7:
            near = ~_beyond(ones, twos, fours, over, radius)
            stay = np.flatnonzero(near)
            if not len(stay):
                return out
            if len(stay) < 0.75 * len(near):
                live = stay if live is None else live[stay]
                ones, twos, fours, over = ones[stay], twos[stay], fours[stay], over[stay]
    near = ~_beyond(ones, twos, fours, over, radius)
    out[slice(None) if live is None else live] = near
    return out


def _beyond(ones, twos, fours, over, radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above | over


def _set_lanes(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(flags.view(np.uint8), bitorder="little"))


def close_lanes(planes: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lane k of ``planes`` against lane k of ``others``: positions of close lanes."""
    pick = lambda x, live: x if live is None else x[live]
    return _set_lanes(_close(lambda b, live: pick(planes[b], live) ^ pick(others[b], live), planes.shape[1], radius))


def close_block(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Every query against every lane of ``planes``: positions (query, lane) of close pairs."""
    width = planes.shape[1]
    bits = (queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    own = np.uint64(0) - bits  # all ones where the bit is set

    def diff(b: int, live: np.ndarray | None) -> np.ndarray:
        if live is None:
            return (own[b][:, None] ^ planes[b][None, :]).ravel()
        return own[b][live // width] ^ planes[b][live % width]

    lanes = _set_lanes(_close(diff, width * len(queries), radius))
    return lanes // (64 * width), lanes % (64 * width)


class Forest:
    """Union by smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, members: np.ndarray) -> np.ndarray:
        up = self.root[members]
        while not np.array_equal(further := self.root[up], up):
            up = further
        self.root[members] = up
        return up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(child, root) of all members that are not roots."""
        roots = self.find(np.arange(len(self.root)))
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return child, roots[child]


def bucket_links(values: np.ndarray, split: int | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs among ``values`` as (child, root) positions.

    With ``split``, only pairs between the first ``split`` values and the rest count.
    """
    forest = Forest(len(values))
    lanes_at = split or 0
    planes = bit_planes(values[lanes_at:])
    for at in range(0, split or len(values), QUERIES):
        queries = values[at : min(at + QUERIES, split or len(values))]
        first = at // 64 if split is None else 0  # earlier lanes have met these queries
        q, lane = close_block(queries, planes[:, first:], radius)
        q, lane = q + at, lane + first * 64 + lanes_at
        real = (lane > q) & (lane < len(values))
        forest.join(q[real], lane[real])
    return forest.links()


def group_links(group: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forests of the links among neighbours with equal ``group`` (sorted): lane i against i + d."""
    forest = Forest(len(values))
    live = np.arange(len(values))
    for d in range(1, len(values)):
        live = live[live + d < len(values)]
        live = live[group[live] == group[live + d]]
        if not len(live):
            break
        near = close_lanes(bit_planes(values[live]), bit_planes(values[live + d]), radius)
        near = live[near[near < len(live)]]
        forest.join(near, near + d)
    return forest.links()


# Candidate buckets


def bucket_keys(fp: str = "fp"):
    """The 16 bucket keys of a fingerprint: which block and part agree, and their bits."""
    keys = []
    for block in range(4):
        own = F.shiftrightunsigned(F.col(fp), 16 * block).bitwiseAND(0xFFFF)
        others = [b for b in range(4) if b != block]
        # the other 48 bits, in four parts of 12
        rest = F.lit(0).cast("long")
        for place, other in enumerate(others):
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(fp), 16 * other).bitwiseAND(0xFFFF), 16 * place))
        for part in range(4):
            bits = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(0xFFF)
            tag = F.lit(block * 4 + part).cast("long")
            keys.append(F.shiftleft(tag, 28).bitwiseOR(F.shiftleft(own, 12)).bitwiseOR(bits))
    return F.array(*keys)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (bucket, tile pair, side, fp) rows; a bucket may span batches."""

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def solve(unit, side, values):
        cuts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        sizes = np.diff(np.append(cuts, len(unit)))
        small = np.repeat(sizes <= SMALL, sizes)
        a, b = group_links(unit[small], values[small])
        if len(a):
            yield emit(values[small][a], values[small][b])
        for at, size in zip(cuts[sizes > SMALL], sizes[sizes > SMALL]):
            own, where = values[at : at + size], side[at : at + size]
            split = int((where == 0).sum()) if where.any() and not where.all() else None
            child, root = bucket_links(own, split)
            if len(child):
                yield emit(own[child], own[root])

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(3)]
        columns[2] = columns[2].view(np.uint64)
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield from solve(*(c[:cut] for c in columns))
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield from solve(*held)


def close_links(marks: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius."""
    spark = marks.sparkSession
    keyed = materialise(marks.select("fp", F.explode(bucket_keys()).alias("bucket")), "buckets")
    sizes = materialise(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bucket_sizes")
    total = keyed.count()
    crowded = skew_join(keyed, sizes, "bucket", "m", max(total, 1)) if total else keyed.withColumn("m", F.lit(1))
    # at most MAX_TILES tiles, so a unit's number holds the bucket (32 bits) and the pair of tiles (31 bits)
    tiles = F.least(F.ceil(F.col("m") / tile), F.lit(MAX_TILES)).cast("long")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit("tile")), tiles)
    units = crowded.select("fp", F.shiftleft("bucket", 31).alias("unit"), tiles.alias("tiles"), own.alias("own"))
    plain = units.where("tiles = 1").select("unit", F.lit(0).cast("tinyint").alias("side"), "fp")
    # a row meets every tile: on side 0 of the pairs (own, later), on side 1 of (earlier, own)
    pairs = units.where("tiles > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")
    tiled = pairs.select(
        (F.col("unit") + pair).alias("unit"), (F.col("own") > F.col("other")).cast("int").cast("tinyint").alias("side"), "fp"
    )
    dealt = plain.unionByName(tiled).repartition("unit").sortWithinPartitions("unit", "side", "fp")
    return dealt.mapInArrow(_linked, "a long, b long")


# Components


def components(links: DataFrame, label: str = "stars") -> DataFrame:
    """(node, root) of every linked node; ``root`` is the smallest node of its component.

    Alternating star contraction: each round writes its links to the shared folder,
    so a lost executor costs one round at most. Stars fold to minima before shuffles.
    """
    spark = links.sparkSession

    def normal(e: DataFrame) -> DataFrame:
        return e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()

    edges = materialise(normal(links), label)
    while True:
        total = edges.count()
        if not total:
            return empty_like(spark, "node long, root long")
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = skew_join(both.where("b > a"), least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(normal(large), label)
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = skew_join(large, least, "a", "n", total)
        small = materialise(
            normal(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))),
            label,
        )
        done = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if done and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


def _placed(docs: DataFrame, extra: dict[str, Column]) -> DataFrame | None:
    """doc_id, fp, root, component_id and the columns ``extra`` of every row; None for no rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marking(F.col("text")).alias("fp"), *[c.alias(k) for k, c in extra.items()])
    with small_batches(docs.sparkSession):
        rows = materialise(own, "fingerprints")
    marks = materialise(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "marks"
    )
    total = marks.agg(F.sum("n")).first()[0]
    if not total:
        return None
    roots = components(materialise(close_links(marks.select("fp")), "links"))
    rooted = materialise(
        marks.join(roots, marks["fp"] == roots["node"], "left").select(
            "fp", "least_id", "n", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = skew_join(rooted, names, "root", "m", total).select("fp", "n", "root", "component_id")
    return skew_join(rows, named, "fp", "n", total).drop("n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    placed = _placed(docs, {})
    if placed is None:
        return empty_like(docs.sparkSession, "doc_id long, fingerprint string, component_id long")
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest id (then digest) stays, with all its columns."""
    placed = _placed(docs, {"text_sha256": F.sha2(normalised(F.col("text")), 256)})
    if placed is None:
        return docs
    placed = materialise(placed.select("doc_id", "text_sha256", "root"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    first = placed.groupBy("root").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    total = placed.count()
    decided = skew_join(placed, materialise(first, "firsts"), "root", "n", total)
    return keep_rows(docs, decided.select("doc_id", "text_sha256", (rank == F.col("first")).alias("kept")))
