"""Jaccard join over word shingles with adaptive multi-match prefixes.

A document's set holds the hashes of its shingles, in one order for all documents: by
a class of how often a hash occurs in the corpus (a counting sketch of fixed size),
rare ones first, then by the hash. Where two sets share ``share`` per cent or more of
their union, the first n - ceil(share n) + l elements of both have l common ones, for
every l up to the overlap. So a set may lengthen its prefix to any level l and ask for
l shared elements in return; a pair is held to the lower of its two levels. Each set
takes the level with the least estimated cost: the postings to scan (the frequencies of
its prefix elements) and the candidates to verify, of which l matches leave at most
postings / l. A set that has fewer than l shared elements at any level has no partner.

Equal sets are folded first. Pairs meet in two ways, so large groups of near copies
never are written out as pairs:

- every set is sent to the blocks of its ``HOMES`` most frequent prefix elements. A
  block counts the shared prefix elements of all its pairs by products of incidence
  matrices, verifies those that reach their level the same way, and gives a spanning
  forest of the links. Large blocks are dealt out as pairs of tiles;
- pairs that share a prefix element but no home, and that the blocks have not connected
  through others, are counted over all elements and verified one by one.

Shingles are compared by 64-bit hashes, sets are folded by 128-bit ones.

Defined results: null and blank texts have an empty set and are linked with nothing; a
null id never names a component (one of null ids only has a null ``component_id``);
repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.workspace import recorded, release

from .common import bounded_slices, empty_like, mark_maybe, materialise, skew_join
from .simhash import Forest, components

WIDTH = 5
SHARE = 80
# Prefixes ask for one of these numbers of shared elements; the higher ones are for larger sets.
LEVELS = (1, 2, 4, 8, 16, 32)
# Blocks a set is compared in; sets of a tile.
HOMES = 4
TILE = 512
# The sketch has 1 << SKETCH_BITS counters, whatever the size of the corpus; its classes are broadcast, a byte each.
SKETCH_BITS = 20
SLICE = 1 << 16
# Characters of text hashed at once.
SLICE_CHARS = 250_000
# Columns of an incidence matrix at once.
COLUMNS = 2048
# Rows in an Arrow batch.
BATCH_ROWS = 500
SCHEMA = "doc_id long, n_shingles long, component_id long"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _random(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit numbers."""
    return np.array([xxhash.xxh3_64_intdigest(b"ngram", seed + i) | 1 for i in range(n)], np.uint64)


# A word's hash is a polynomial over a number per byte, those of A to Z being those of a to z.
_BYTES = _random(256, 0)
_BYTES[65:91] = _BYTES[97:123]
_FACTORS = _random(WIDTH, 1000)
_BASE, _LENGTH, *_MIX = _random(4, 2000)
_CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        _POWERS[:] = []
        for factor in (_BASE, np.uint64(inverse)):
            steps = np.full(max(n, _CHUNK), factor, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> np.uint64(30)
    values *= _MIX[0]
    values ^= values >> np.uint64(27)
    values *= _MIX[1]
    values ^= values >> np.uint64(31)
    return values


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in ``raw`` bytes that end with a separator."""
    hashes, starts = [], []
    at = 0
    while at < len(raw):
        end = min(at + _CHUNK, len(raw))
        # a chunk ends behind a separator; a word longer than that is a chunk of its own
        while not _SPACE[raw[end - 1]]:
            back = np.flatnonzero(_SPACE[raw[at:end]])
            end = at + int(back[-1]) + 1 if len(back) else min(end + _CHUNK, len(raw))
        part = raw[at:end]
        letter = ~_SPACE[part]
        edges = np.flatnonzero(np.diff(letter, prepend=False))
        first, last = edges[::2], edges[1::2]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[: len(part)], dtype=np.uint64)])
        own = (sums[last] - sums[first]) * down[first]
        hashes.append(_mixed(own + (last - first).astype(np.uint64) * _LENGTH))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Ascending distinct hashes of the 5-word shingles of each text; of the whole sequence if it is shorter."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, starts = word_hashes(np.frombuffer(b"".join(r + b" " for r in raws), np.uint8))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
    full = np.full(max(len(words) - WIDTH + 1, 0), WIDTH, np.uint64)
    for place in range(WIDTH):
        full += words[place : place + len(full)] * _FACTORS[place]
    full = _mixed(full)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= WIDTH:
            own = np.sort(full[a : b - WIDTH + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = _mixed(np.array([b - a], np.uint64) + (words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64))
        else:
            own = words[:0]
        out.append(own)
    return out


def _key(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def required(n):
    """The least overlap of a set of ``n`` with any partner."""
    return (SHARE * n + 99) // 100


def highest_level(n: int) -> int:
    """The highest level open to a set of ``n``: no more than the least overlap, and a prefix not much longer than at level 1."""
    return max(level for level in LEVELS if level == 1 or level <= min(required(n), n // 32 + 4))


# Order


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for _, texts in bounded_slices(batches, chars=SLICE_CHARS):
        np.add.at(counts, (np.concatenate(shingle_sets(texts)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
    for at in range(0, len(counts), SLICE):
        # byte planes: the upper ones are nearly all zero and compress well
        part = counts[at : at + SLICE].view(np.uint8).reshape(-1, 4).T
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([at // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
            sums[at] = sums[at] + part if at in sums else part.astype(np.uint64)
    for at, total in sums.items():
        classes = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["slice", "classes"])


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """A class per counter of the sketch: twice the binary logarithm of its count over all documents."""
    counted = docs.select("text").mapInArrow(_counted, "slice int, counts binary")
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in counted.repartition("slice").mapInArrow(_classed, "slice int, classes binary").collect():
        classes[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["classes"], np.uint8)
    return classes


def ordered_prefix(own: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The elements that a set of these hashes may match with at its highest level, rare ones first."""
    order = np.argsort(classes[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return own[order[: len(own) - required(len(own)) + highest_level(len(own))]]


def prefixes(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """doc_id, n, key and the longest prefix of every document."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in bounded_slices(batches, chars=SLICE_CHARS):
            sizes, keys, held = [], [], []
            for own in shingle_sets(texts):
                sizes.append(len(own))
                keys.append(_key(own))
                held.append(ordered_prefix(own, classes) if len(own) else own)
            ends = np.cumsum([0, *map(len, held)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), tokens], ["doc_id", "n", "key", "tokens"]
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(prefix, "doc_id long, n long, key binary, tokens array<long>")


# Levels


def _need(n: Column) -> Column:
    return F.floor((n * SHARE + 99) / 100)


def _levels(shared: DataFrame) -> DataFrame:
    """node, level of the sets that may have partners; ``shared`` holds (node, n, token, first_level, df).

    A level costs its postings to scan, and the candidates to verify element by
    element: each of them takes ``level`` postings at least.
    """
    within = {k: F.col("first_level") <= k for k in LEVELS}
    sums = shared.groupBy("node", "n").agg(
        *[F.sum(F.when(within[k], F.col("df") - 1).otherwise(0)).alias(f"s{k}") for k in LEVELS],
        *[F.sum(F.when(within[k], 1).otherwise(0)).alias(f"c{k}") for k in LEVELS],
    )
    n = F.col("n")
    able = {k: F.lit(k == 1) | ((_need(n) >= k) & (n >= 32 * (k - 4))) for k in LEVELS}
    possible = F.lit(True)
    for k in LEVELS:
        possible = possible & ((F.col(f"c{k}") >= k) | ~able[k])
    costs = {k: F.col(f"s{k}") * (F.lit(1.0) + n / k) for k in LEVELS}
    choices = [F.when(able[k], F.struct(costs[k].alias("cost"), F.lit(k).alias("level"))) for k in LEVELS]
    return sums.where(possible).select("node", F.least(*choices)["level"].alias("level"))


def _shared(classes: DataFrame) -> DataFrame:
    """The prefix elements that several sets have: node, n, token, first_level, df."""
    base = F.col("n") - _need(F.col("n")) + 1
    first = F.greatest(F.lit(1), (F.col("at") - base + 2).cast("int"))
    entries = classes.select("node", "n", F.posexplode("tokens").alias("at", "token"))
    entries = entries.select("node", "n", "token", first.cast("int").alias("first_level"))
    total = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return _recounted(entries, total, "join_shared")


def _recounted(entries: DataFrame, total: int, label: str) -> DataFrame:
    """The entries whose token several sets have, with their number ``df``."""
    counts = materialise(entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join_counts")
    # the filter only spares the others the way; its size follows the number of shared tokens up to 32 MB
    bits = 1 << max(16, min(28, (16 * counts.count()).bit_length()))
    likely = mark_maybe(entries, counts, ["token"], "maybe", bits).where("maybe").drop("maybe")
    return materialise(skew_join(likely, counts, "token", "df", max(total, 1)), label)


# Blocks


def _incidence(rows: np.ndarray, tokens: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Matrices (n sets, some elements) of ones, over the elements that two or more sets have."""
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    often = count[column] > 1
    rows, column = rows[often], number[column[often]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            out = np.zeros((n, min(COLUMNS, width - k * COLUMNS)), np.float32)
            out[rows[a:b], column[a:b] - k * COLUMNS] = 1
            yield out


def _common(rows: np.ndarray, tokens: np.ndarray, n: int, split: int) -> np.ndarray:
    """How many elements the sets before ``split`` share with those from it on; with split 0 all with all."""
    out = np.zeros((split or n, n - split), np.float32)
    for part in _incidence(rows, tokens, n):
        out += part[: split or n] @ part[split:].T
    return out


def block_links(sizes, levels, prefix, firsts, sets, split: int = 0, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links among the sets of a block; with ``split``, of those across it."""
    n = len(sizes)
    rows = np.repeat(np.arange(n), [len(p) for p in prefix])
    tokens, first = np.concatenate(prefix), np.concatenate(firsts)
    lower = np.minimum.outer(levels[: split or n], levels[split:])
    small = np.minimum.outer(sizes[: split or n], sizes[split:])
    able = 100 * small >= share * np.maximum.outer(sizes[: split or n], sizes[split:])
    if not split:
        able = np.triu(able, 1)
    candidates = np.zeros_like(able)
    for level in np.unique(lower[able]):
        inside = first <= level
        candidates |= able & (lower == level) & (_common(rows[inside], tokens[inside], n, split) >= level)
    x, y = np.nonzero(candidates)
    forest = Forest(n)
    if len(x):
        y = y + split
        live = np.unique(np.concatenate([x, y]))
        at = np.full(n, -1)
        at[live] = np.arange(len(live))
        within = int((live < split).sum())
        both = _common(np.repeat(np.arange(len(live)), sizes[live]), np.concatenate([sets[i] for i in live]), len(live), within)
        both = both[at[x], at[y] - within].astype(np.int64)
        linked = 100 * both >= share * (sizes[x] + sizes[y] - both)
        forest.join(x[linked], y[linked])
    return forest.links()


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (home, pair, side); a block may span batches."""

    def solve(block: list[tuple]) -> pa.RecordBatch:
        side, nodes, sizes, levels, prefix, firsts, sets = zip(*block)
        split = side.index(1) if 0 in side and 1 in side else 0
        child, root = block_links(
            np.array(sizes), np.array(levels), [np.frombuffer(p, "<i8") for p in prefix], [np.frombuffer(f, np.uint8) for f in firsts],
            [np.frombuffer(s, "<u8") for s in sets], split,
        )
        nodes = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root])], ["a", "b"])

    held: list[tuple] = []
    current = None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for home, pair, *row in zip(*columns):
            if (home, pair) != current:
                if len(held) > 1:
                    yield solve(held)
                current, held = (home, pair), []
            held.append(tuple(row))
    if len(held) > 1:
        yield solve(held)


def _tiled(rows: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with pair and side: groups of more than TILE rows are dealt out as pairs of tiles."""
    tiles = F.ceil(F.col(count) / TILE).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("tile")), tiles).cast("int")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    pair = F.least(own, "other").cast("long") * tiles + F.greatest(own, "other")
    return dealt.withColumns({"pair": pair, "side": (own > F.col("other")).cast("tinyint")}).drop("other")


def _block_links(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    spread = materialise(wanted.select("node", F.explode("homes").alias("home")), "join_homes")
    sizes = spread.groupBy("home").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = _tiled(skew_join(spread, materialise(sizes, "join_sizes"), "home", "m", max(spread.count(), 1)), "home", "m")
    # blocks are dealt out before the sets are made, so these travel once to their key and once to each block
    units = dealt.groupBy("node").agg(F.collect_list(F.struct("home", "pair", "side")).alias("units"))
    members = _sets_of(docs, materialise(wanted.drop("homes").join(units, "node"), "join_units"))
    placed = members.select(F.inline("units"), "node", "n", "level", "prefix", "firsts", "own")
    ordered = placed.repartition("home", "pair").sortWithinPartitions("home", "pair", "side", "node")
    return ordered.mapInArrow(_in_blocks, "a long, b long")


# Pairs without a common home


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, level) of sorted rows (token, pair, side, node, n, first_level, level, root, homes) that share neither root nor home."""

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, pair, side, node, n, first, level, root, *homes = columns
        alive = np.arange(len(token))
        for d in range(1, len(token)):
            alive = alive[alive + d < len(token)]
            other = alive + d
            same = (token[alive] == token[other]) & (pair[alive] == pair[other])
            alive = alive[same]
            if not len(alive):
                return
            other = alive + d
            lower = np.minimum(level[alive], level[other])
            good = (first[alive] <= lower) & (first[other] <= lower)
            good &= 100 * np.minimum(n[alive], n[other]) >= SHARE * np.maximum(n[alive], n[other])
            good &= (crossing[alive] <= (side[alive] != side[other])) & (root[alive] != root[other])
            for h in homes:
                for g in homes:
                    good &= (h[alive] != g[other]) | (h[alive] == -1)
            x, y = node[alive[good]], node[other[good]]
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(lower[good].astype(np.int32))], ["x", "y", "level"]
                )

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        if not len(columns[0]):
            continue
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = int(np.argmax(last))
        held = [c[cut:] for c in columns]
        if cut:
            columns = [c[:cut] for c in columns]
            crossing = _two_sided(*columns[:3])
            yield from pairs(columns)
    if held is not None and len(held[0]):
        crossing = _two_sided(*held[:3])
        yield from pairs(held)


def _two_sided(token: np.ndarray, pair: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows of groups that lie on both sides: only pairs across count there."""
    opens = np.append(True, (token[1:] != token[:-1]) | (pair[1:] != pair[:-1]))
    group = np.cumsum(opens) - 1
    high = np.maximum.reduceat(side, np.flatnonzero(opens))
    low = np.minimum.reduceat(side, np.flatnonzero(opens))
    return (high != low)[group]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, keep = batch.column(0), batch.column(1), []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SHARE * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def _lone_links(docs: DataFrame, entries: DataFrame, wanted: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Links between sets that share prefix elements but no home; None if there is no such pair.

    Sets with one ``root`` are connected already, another link between them would tell nothing.
    """
    counts = materialise(entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "join_matches")
    homes = [F.coalesce(F.get("homes", F.lit(i)), F.lit(-1)).alias(f"h{i}") for i in range(HOMES)]
    placed = entries.join(wanted.select("node", "homes"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = _tiled(skew_join(placed, counts, "token", "m", max(entries.count(), 1)), "token", "m")
    rows = dealt.select("token", "pair", "side", "node", "n", "first_level", "level", "root", *homes)
    ordered = rows.repartition("token", "pair").sortWithinPartitions("token", "pair", "side", "node")
    met = ordered.mapInArrow(_apart, "x long, y long, level int")
    enough = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.first("level").alias("level")).where("c >= level")
    enough = materialise(enough.select("x", "y"), "join_pairs")
    nodes = enough.select(F.col("x").alias("node")).unionByName(enough.select(F.col("y").alias("node"))).distinct()
    if nodes.isEmpty():
        return None
    own = _sets_of(docs, materialise(wanted.select("node", "key", "least_id").join(nodes, "node"), "join_lone"))
    own = materialise(own.select("node", "own"), "join_lone_sets")
    both = enough.join(own.toDF("x", "own_x"), "x").join(own.toDF("y", "own_y"), "y").select("x", "y", "own_x", "own_y")
    return both.mapInArrow(_verified, "a long, b long")


# The join


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, least_id, ...) with the whole set ``own`` of each key, made again from the texts of those ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in bounded_slices(batches, chars=SLICE_CHARS):
            own = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(o) for o in own], pa.binary()), pa.array([o.tobytes() for o in own], pa.binary())], ["key", "own"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("least_id"), "text")
    marked = mark_maybe(rows, wanted.select("least_id"), ["least_id"], "maybe").where("maybe").select("text")
    found = marked.mapInArrow(sets, "key binary, own binary").where("key IS NOT NULL")
    once = found.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("own").alias("own"))
    return wanted.join(once, "key")


def _pruned(classes: DataFrame) -> DataFrame:
    """Prefix elements of the sets that may have partners: node, n, token, first_level, level, df."""
    shared = _shared(classes)
    total = shared.count()
    while True:
        levels = materialise(_levels(shared), "join_levels")
        entries = shared.drop("df").join(levels, "node")
        # elements whose other sets are out make their own set less likely in turn
        fewer = _recounted(entries.drop("level"), total, "join_shared")
        n = fewer.count()
        if 10 * n >= 9 * total:
            return materialise(fewer.join(levels, "node").where("first_level <= level"), "join_entries")
        shared, total = fewer, n


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows here hold whole sets: fewer of them go to Python at once while the block runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    with _small_batches(docs.sparkSession):
        return _join(docs)


def _join(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    with recorded() as scratch:
        sets = materialise(prefixes(docs, frequency_classes(docs)), "join_sets")
        folded = sets.where("n > 0").groupBy("key").agg(
            F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows"), F.first("tokens").alias("tokens")
        )
        classes = materialise(folded.withColumn("node", F.monotonically_increasing_id()), "join_classes")
    rows = materialise(sets.drop("tokens"), "join_rows")
    nodes = materialise(classes.drop("tokens"), "join_nodes")
    with recorded() as more:
        entries = _pruned(classes)
    # the prefixes of all documents are not needed any more
    release(spark, [*scratch, *more[:-1]])

    ranked = F.sort_array(F.collect_list(F.struct("df", "token")), asc=False)
    packed = F.collect_list(F.struct("token", "first_level"))
    gathered = entries.groupBy("node", "n", "level").agg(ranked.alias("ranked"), packed.alias("packed"))
    shown = gathered.select(
        "node", "n", "level", F.slice(F.col("ranked.token"), 1, HOMES).alias("homes"),
        F.col("packed.token").alias("tokens"), F.col("packed.first_level").alias("first_levels"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [[np.asarray(v, kind).tobytes() for v in batch.column(i).to_pylist()] for i, kind in ((4, "<i8"), (5, np.uint8))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(r, pa.binary()) for r in raw],
                ["node", "n", "level", "homes", "prefix", "firsts"],
            )

    shown = shown.mapInArrow(pack, "node long, n long, level int, homes array<long>, prefix binary, firsts binary")
    wanted = materialise(shown.join(nodes.select("node", "key", "least_id"), "node"), "join_wanted")
    with recorded() as more:
        links = materialise(_block_links(docs, wanted), "join_links")
    release(spark, more[:-1])
    roots = components(links, "join_stars")
    lone = _lone_links(docs, entries, wanted, roots)
    if lone is not None:
        lone = materialise(lone, "join_lone_links")
        if not lone.isEmpty():
            roots = components(links.unionByName(lone), "join_stars")

    named = nodes.join(roots, "node", "left")
    named = materialise(named.withColumn("root", F.coalesce("root", "node")), "join_roots")
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    total = rows.count()
    if not total:
        return empty_like(spark, SCHEMA)
    facts = skew_join(named, names, "root", "m", total).select("key", "rows", "component_id")
    placed = skew_join(rows.where("n > 0"), facts, "key", "rows", total)
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = placed.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
