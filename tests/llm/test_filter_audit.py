import re
from itertools import permutations

from pyspark.sql import functions as F

from millrace.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, text string"


def masks(rows):
    """Failed filters of every (doc_id, text), by definition."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        mask = (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        mask += 8 * bool(re.search("[#$%&*|]", t))
        mask += 16 * any(i is not None and doc_id is not None and i < doc_id and (x or "") == t for i, x in rows)
        out.append(mask)
    return out


def brute(rows, labels):
    """rows of (doc_id, text, source), labels of (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    known = list(zip(rows, masks([(i, t) for i, t, _ in rows])))
    for part in {s or "" for *_, s in rows}:
        own = [(i, m) for (i, _, s), m in known if (s or "") == part]
        removed = {}
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(i, m) for i, m in left if m & bit]
                left = [(i, m) for i, m in left if not m & bit]
                failing = [m for _, m in own if m & bit]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(m == bit for m in failing),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                removed[letter] = removed.get(letter, 0) + len(gone)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step].append(removed[letter])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*A.COUNTS, "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


def test_edges(spark, edges, edge_rows, nothing):
    labels = [(1, 1, 0, "x"), (2, 1, 1, None), (2, 0, 0, None), (3, None, 1, None), (None, 1, 1, None), (9, 1, None, None), (77, 1, 1, None)]
    table = spark.createDataFrame(labels, LABELS)
    assert found(A.audit(edges, table)) == brute([(r[0], r[1], r[3]) for r in edge_rows], [x[:3] for x in labels])
    assert found(A.audit(edges, table.limit(0))) == brute([(r[0], r[1], r[3]) for r in edge_rows], [])
    assert A.audit(nothing, table).collect() == []


def test_filters_that_overlap(spark):
    texts = ["a b", "A #", "x " * 60, "Word" * 3 + " y" * 80 + " $", " ".join(f"w{i}" for i in range(70)), "a b", ""]
    rows = [(i, texts[i * 5 % 7], None if i % 3 else "s") for i in range(60)]
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = found(A.audit(docs, spark.createDataFrame([(*x, None) for x in labels], LABELS)))
    assert got == brute(rows, labels)
    assert len(got) == 2 * 120 * 5


def test_hot_groups_fold_before_they_meet(spark):
    """One text, one id and one source on nearly all of 100,000 rows."""
    ids = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id"))
    docs = spark.range(100_000, numPartitions=8).select(ids.alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([(7, 1, 0, None)], LABELS)
    got = found(A.audit(docs, labels))
    # 50,001 rows with id 7; all fail the word count, so copies go by E where it comes before A: in half of the orders
    assert got["s", "EABCD", 1] == (1, 99_999, 0, 0, 50_001, 0, 99_999 * 60)
