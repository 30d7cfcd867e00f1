import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import conversation_repair as R

SPACE = "\x20\t\n\x0b\x0c\r"


def damaged(rows):
    """Rows (conv, turn, role, text) after damage, by definition."""
    out = []
    for conv, turn, role, text in rows:
        text, who = (" " if text is None else text), (" " if role is None else role)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else who, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) of the best edits: every path with its whole audit, no shared nodes."""
    marks = faults(rows)
    best = {}
    def legal(initials):
        return re.fullmatch("s?(ua)*u?", initials) is not None

    # states: number of rows read and the initials so far, reduced to what the pattern can tell apart
    def state(initials):
        return initials if len(initials) < 2 else initials[-1]

    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        key = (at, state(initials))
        if key in best:
            continue
        best[key] = (cost, audit, lines)
        moves = [(3, "I", at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            moves.append((4, "D", at + 1, None, None))
            if marks[at] not in ("blank", "duplicate"):
                late = 3 if marks[at] == "truncated" else 0
                if role:
                    moves.append((late, "K", at + 1, role, f"{role}:{text}"))
                moves += [(3 + late, "R", at + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for more, letter, to, role, line in moves:
            grown = initials + (role[0] if role else "")
            if legal(grown):
                heapq.heappush(heap, (cost + more, audit + letter, to, grown if len(grown) < 3 else "s"[: grown[0] == "s"] + "ua"[: 1 + (grown[-1] == "a")], (*lines, line) if line else lines))
    ends = [v for (at, s), v in best.items() if at == len(rows) and (s == "" or s[-1] == "a")]
    return min(ends)


def every_audit(rows, most):
    """Least (cost, audit) over all letter sequences with at most ``most`` insertions, by trial."""
    marks, found = faults(rows), []
    for inserts in range(most + 1):
        for places in itertools.combinations(range(len(rows) + inserts), inserts):
            for letters in itertools.product("KRD", repeat=len(rows)):
                it, audit, cost, initials, ok, at = iter(letters), "", 0, "", True, 0
                for k in range(len(rows) + inserts):
                    c = "I" if k in places else next(it)
                    audit += c
                    expected = "a" if initials[-1:] == "u" else "u"
                    if c in "KRD":
                        role, mark = rows[at][0], marks[at]
                        at += 1
                        ok &= c == "D" or mark not in ("blank", "duplicate")
                        cost += 3 if c != "D" and mark == "truncated" else 0
                    cost += {"K": 0, "R": 3, "D": 4, "I": 3}[c]
                    initials += "" if c == "D" else role[:1] if c == "K" else expected
                if ok and re.fullmatch("(s?(ua)+)?", initials):
                    found.append((cost, audit))
    return min(found)


def brute(rows):
    convs = {}
    for row in rows:
        convs.setdefault(row[0], [])
    for conv, turn, role, text in damaged(rows):
        convs[conv].append(((turn is not None, turn or 0), role, text, turn))
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: r[:3])
        pairs = [(r, t) for _, r, t, _ in held]
        marks = faults(pairs)
        turns = [t for *_, t in held if t is not None]
        cost, audit, lines = cheapest(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return sorted(out, key=str)


def run(rows, settle=R.SETTLE, paths=R.Paths):
    one = R.Repair(1, settle, paths)
    for role, text in rows:
        one.add(None, role, text)
    return one.result()


@pytest.mark.parametrize("seed", range(40))
def test_all_sequences(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!", "d?"])) for _ in range(rng.randint(0, 4))]
    want = every_audit(rows, 3)
    assert run(rows)[6:8] == want == cheapest(rows)[:2]


@pytest.mark.parametrize("settle", [4, 64, R.SETTLE])
def test_long_conversations(settle, monkeypatch):
    monkeypatch.setattr(R, "SETTLE", settle)
    rng = random.Random(settle)
    for n in (1, 7, 60, 400):
        rows = [(rng.choice(["user", "user", "assistant", "system", ""]), f"{rng.randint(0, n)}{rng.choice('. !x')}") for _ in range(n)]
        cost, audit, lines = cheapest(rows)
        got = run(rows, settle)
        assert got[6:8] == (cost, audit)
        assert got[8] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_colliding_hashes_are_verified():
    class Weak(R.Paths):
        def __init__(self):
            super().__init__(lambda above, letter: 0 if letter in "KR" else (above + ord(letter)) % 3)

    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 30)}{rng.choice('. x')}") for _ in range(12)]
        assert run(rows, paths=Weak)[6:8] == cheapest(rows)[:2]


def test_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = R.repair(broken := R.damage(table), broken["copies"])
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark):
    rng = random.Random(1)
    schema = "conv_id long, turn long, role string, text string, audit string, copies string, cost int"
    rows = [(c, t, rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice([None, "", " \n", "x.", "y", "é!", "z? "]))
            for c in [None, *range(60)] for t in [None, *rng.sample(range(9), 5)]]
    rows += rows[:40] + [(99, None, None, None), (100, -(2**63), "user", "a."), (100, 2**63 - 1, "assistant", "b."), (101, 1, "user", "word " * 200_000)]
    dropped = next(t for t in range(200) if zlib.crc32(f"500:{t}".encode()) % 20 == 0)
    rows.append((500, dropped, "user", "gone."))
    docs = spark.createDataFrame([(*r, "x", None, 1) for r in rows], schema).repartition(5)
    got = sorted(map(tuple, R.repair(broken := R.damage(docs), broken["copies"]).collect()), key=str)
    want = [(*w[:1], min(w[1], 2**63 - 1), *w[2:]) for w in brute(rows)]
    assert got == want
    assert (500, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert R.repair(docs.limit(0)).collect() == []


def test_one_conversation_of_100_000_rows(spark):
    role = F.element_at(F.array(*map(F.lit, ["user", "assistant", "user", "user", "system"])), (F.col("id") * 7 % 5 + 1).cast("int"))
    rows = spark.range(100_000, numPartitions=8).select(
        F.lit(1).alias("conv_id"), (F.col("id") / 2).cast("long").alias("turn"), role.alias("role"), F.concat(F.col("id"), F.lit(".")).alias("text")
    )
    got = R.repair(rows).collect()
    assert len(got) == 1 and len(got[0].audit.replace("I", "")) == 100_000
