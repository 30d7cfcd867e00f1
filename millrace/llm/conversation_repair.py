"""Conversation structure repair: the cheapest edits that give a legal order of roles.

The rows of a conversation run once through a dynamic program over four states (nothing
yet, after the system, after the user, after the assistant). Edits are kept as linked
nodes, so the paths of all states share their prefixes; a node knows its ancestors at
powers of two and the rolling hash of the letters above it. Two paths of one cost are
told apart by a search for their longest common prefix over these hashes; what the
hashes call equal is verified letter by letter up to the node both paths share. Once all
states share a prefix, it is settled: its letters leave the table and its repaired rows
go into the digest, so memory follows the undecided rest.

Comparing prefixes is enough: two paths with one cost, state and row never are prefixes
of each other (the longer one would hold more insertions at a higher cost), so the first
difference decides, whatever follows.

A conversation is one task's stream, sorted by Spark: its digest is one SHA-256 over all
repaired rows and cannot be split. Beside the undecided rest a task holds one 16-byte
digest per distinct row of the conversation it is in.

Defined results: a null role or text is one space, a null conversation is one of its
own; rows with one turn are taken by role and text; an empty role is no legal one; gaps
end at the largest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
# Costs of the edits, separators of words, ends of sentences, legal neighbours.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE_CHARS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")

# States, what a role's initial leads to from each, and whose turn it is in each.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = ("user", "user", "assistant", "user")

_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E6F
# Nodes in the table before the settled prefix is looked for.
SETTLE = 4096


class Paths:
    """Edit letters as a tree of linked nodes; node 0 is the settled prefix."""

    def __init__(self, hashing=lambda above, letter: (above * _BASE + ord(letter)) % _PRIME):
        self.hashing = hashing
        self.letters = [""]
        self.depths = array("q", [0])
        self.hashes = [0]
        self.ups = [array("q", [0])]  # ups[j][i]: the ancestor of i that is 2 ** j letters above, or 0

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letters)
        self.letters.append(letter)
        depth = self.depths[parent] + 1
        self.depths.append(depth)
        self.hashes.append(self.hashing(self.hashes[parent], letter))
        while depth >> len(self.ups):
            self.ups.append(array("q", bytes(8 * node)))
        at = parent
        for level in self.ups:
            level.append(at)
            at = level[at]
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` at ``depth``."""
        above = self.depths[node] - depth
        j = 0
        while above:
            if above & 1:
                node = self.ups[j][node]
            above >>= 1
            j += 1
        return node

    def compare(self, a: int, b: int) -> int:
        """Negative, zero or positive as the letters of ``a`` are less, equal or greater."""
        depth = min(self.depths[a], self.depths[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.hashes[x] != self.hashes[y]:
            for level in reversed(self.ups):
                if self.hashes[level[x]] != self.hashes[level[y]]:
                    x, y = level[x], level[y]
            first = self._unequal(self.ups[0][x], self.ups[0][y]) or (x, y)
        else:
            first = self._unequal(x, y)
        if first is None:
            return self.depths[a] - self.depths[b]
        return ord(self.letters[first[0]]) - ord(self.letters[first[1]])

    def _unequal(self, x: int, y: int) -> tuple[int, int] | None:
        """The first difference of two paths of one length that the hashes call equal, if there is one."""
        found = None
        while x != y:
            if self.letters[x] != self.letters[y]:
                found = (x, y)
            x, y = self.ups[0][x], self.ups[0][y]
        return found

    def path(self, node: int, above: int = 0) -> list[str]:
        """The letters below ``above`` down to ``node``."""
        out = []
        while node != above:
            out.append(self.letters[node])
            node = self.ups[0][node]
        return out[::-1]

    def shared(self, nodes: list[int]) -> int:
        """The deepest node above all ``nodes``."""
        depth = min(self.depths[n] for n in nodes)
        nodes = [self.lift(n, depth) for n in nodes]
        while len(set(nodes)) > 1:
            nodes = [self.ups[0][n] for n in nodes]
        return nodes[0]


class Repair:
    """The dynamic program over one conversation, row by row."""

    def __init__(self, conv_id: int | None, settle: int = SETTLE, paths=Paths):
        self.conv_id = conv_id
        self.settle = settle
        self.new_paths = paths
        self.paths = paths()
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.counts = dict.fromkeys(COUNTS, 0)
        self.least = self.most = self.last_turn = None
        self.turns = 0
        self.seen: set[bytes] = set()
        self.last_initial: str | None = None
        # what the settled prefix has become, and the rows below it
        self.rows: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.state = START
        self.digest = hashlib.sha256()
        self.any = False
        self._insert()

    def _offer(self, best: list, state: int, cost: int, parent: int, letter: str) -> None:
        held = best[state]
        if held is not None and held[0] < cost:
            return
        node = self.paths.add(parent, letter)
        if held is None or cost < held[0] or self.paths.compare(node, held[1]) < 0:
            best[state] = (cost, node)

    def _insert(self) -> None:
        """Insertions: to the user's turn first, from there to the assistant's (no more can pay)."""
        for state in (START, SYSTEM, ASSISTANT, USER):
            if self.best[state] is not None:
                cost, node = self.best[state]
                self._offer(self.best, STEPS[state][NEXT[state][0]], cost + INSERT, node, "I")

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
            self.turns += 1
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last_initial = initial

        body = text.rstrip(SPACE_CHARS)
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        forced, late = True, 0
        if not body:
            self.counts["blank"] += 1
        elif mark in self.seen:
            self.counts["duplicate"] += 1
        else:
            forced = False
            if body[-1] not in ENDS:
                self.counts["truncated"] += 1
                late = TRUNCATED
        self.seen.add(mark)

        new: list[tuple[int, int] | None] = [None] * 4
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._offer(new, state, cost + DELETE, node, "D")
            if not forced:
                to = STEPS[state].get(initial)
                if to is not None:
                    self._offer(new, to, cost + late, node, "K")
                self._offer(new, STEPS[state][NEXT[state][0]], cost + REROLE + late, node, "R")
        self.best = new
        self._insert()
        self.rows.append((role, text))
        if len(self.paths.letters) > self.settle:
            self._settle()

    def _settle(self) -> None:
        """Write what all paths share, keep the rest in a new table."""
        live = [held for held in self.best if held is not None]
        root = self.paths.shared([node for _, node in live])
        self._write(self.paths.path(root))
        old, self.paths = self.paths, self.new_paths()
        at = {root: 0}
        for held in live:
            below, node = [], held[1]
            while node not in at:
                below.append(node)
                node = old.ups[0][node]
            for node in reversed(below):
                at[node] = self.paths.add(at[old.ups[0][node]], old.letters[node])
        self.best = [None if held is None else (held[0], at[held[1]]) for held in self.best]
        # what stays undecided is looked at again only after it has doubled
        self.settle = max(SETTLE, 2 * len(self.paths.letters))

    def _write(self, letters: list[str]) -> None:
        taken = 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.rows[taken]
            taken += letter != "I"
            if letter == "D":
                continue
            role = role if letter == "K" else NEXT[self.state]
            self.state = STEPS[self.state][role[0]]
            line = f"{role}:{text}"
            self.digest.update((("\n" if self.any else "") + line).encode("utf-8", "surrogatepass"))
            self.any = True
        self.rows = self.rows[taken:]
        self.audit.append("".join(letters))

    def result(self) -> tuple:
        ends = [held for held in (self.best[START], self.best[ASSISTANT]) if held is not None]
        cost, node = ends[0]
        for other in ends[1:]:
            if other[0] < cost or other[0] == cost and self.paths.compare(other[1], node) < 0:
                cost, node = other
        self._write(self.paths.path(node))
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)
        counts = self.counts | {"cost": cost}
        return (self.conv_id, gaps, *[counts[k] for k in COUNTS], "".join(self.audit), self.digest.hexdigest())


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("gaps", pa.int64()), *[(k, pa.int64()) for k in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, copies) of whole conversations; one may span batches."""
    current: Repair | None = None
    done: list[tuple] = []

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _ARROW)], schema=_ARROW)
        done.clear()
        return out

    for batch in batches:
        for conv_id, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.result())
                current = Repair(conv_id)
            for _ in range(copies):
                current.add(turn, role, text)
        if done:
            yield emit()
    if current is not None:
        done.append(current.result())
        yield emit()


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as a faulty collection would hold them, decided by crc32 of ``conv_id:turn``; ``copies`` is 0 for dropped rows."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): faults, cost, audit, digest.

    ``copies`` says how often a row stands in the conversation; a conversation whose
    rows all have none is reported as an empty one.
    """
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(_repaired, SCHEMA)
