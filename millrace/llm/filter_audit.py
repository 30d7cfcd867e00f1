"""Filter interaction audit: what each filter removes under every order of the filters.

A document's failed filters are a bit mask, so the corpus folds into few cells (part,
mask) with counts. Every cell is folded across the array of all orders (``aggregate``
runs along one order with the mask of earlier filters as its state, ``transform`` goes
over the orders), which gives one struct of weighted counts per order and step; the
structs of a part's cells are merged by elementwise sums. All of it is column
expressions; the orders are a literal of the plan, 120 x 5 small integers.

Whether an equal text with a smaller id exists is a fact of the corpus: rows fold to
(text digest, part, labels) with their least id before they meet by digest, so a group
of copies is a few rows wherever its members lie.

Defined results: a null text is empty (it fails the word count, and is a copy where a
smaller id has no text either); a null source and an empty one are one part; a null id
is never smaller than another and never has a smaller one; rows equal in id and text
do not make each other copies; several labels of one id count as 1 if any is 1, rows
without an id have no label; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import HOT_KEYS, materialise, skew_join, words

LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
# The letters of the filters; the last one is the copy of an earlier text.
LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> list[Column]:
    """The failure conditions that a text decides alone, in the order of their letters."""
    text = F.coalesce(text, F.lit(""))
    parts = words(text)
    n = F.size(parts)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        n < LEAST_WORDS,
        F.size(F.array_distinct(parts)) * 100 < n * LEAST_DISTINCT,
        capitals * 100 > F.length(text) * MOST_CAPITALS,
        text.rlike("[#$%&*|]"),
    ]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with good and toxic; ids that many rows share are served by broadcast."""
    marks = labels.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    ).where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.where("id IS NOT NULL")
    counts = known.groupBy("id").agg(F.count(F.lit(1)).alias("m"))
    total = rows.count()
    hot = materialise(counts.where(F.col("m") * HOT_KEYS >= max(total, HOT_KEYS * 2)).select("id"), "hot_ids")
    served = known.join(F.broadcast(hot.join(marks, "id", "left")), "id")
    rest = known.join(F.broadcast(hot), "id", "left_anti").join(marks, "id", "left")
    none = rows.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    all_rows = served.unionByName(rest).unionByName(none)
    return all_rows.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters in ``mask``."""
    own = F.lit(0)
    for bit, failed in enumerate(own_failures(F.col("text"))):
        own = own + F.when(failed, 1 << bit).otherwise(0)
    facts = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"),
        own.alias("own"),
    )
    facts = materialise(facts, "audit_facts")
    folded = materialise(facts.groupBy("id", "part", "sha", "own").agg(F.count(F.lit(1)).alias("n")), "audit_rows")
    key = ["sha", "part", "own", "good", "toxic"]
    groups = materialise(
        _labelled(folded, labels)
        .groupBy(*key)
        .agg(
            F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        ),
        "audit_groups",
    )
    firsts = groups.groupBy("sha").agg(F.min("least.id").alias("first"), F.count(F.lit(1)).alias("m"))
    met = skew_join(groups, firsts, "sha", "m", max(groups.count(), HOT_KEYS * 2))
    stays = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copied = 1 << len(LETTERS) - 1
    split = F.array(
        F.struct(F.col("own").alias("mask"), stays.alias("n")),
        F.struct((F.col("own") + copied).alias("mask"), (F.col("n") - stays).alias("n")),
    )
    counted = met.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    weight = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight("good").alias("good"), weight("toxic").alias("toxic"))


def _orders(n: int) -> Column:
    """All orders of ``n`` filters as an array of arrays of their numbers."""
    return F.expr("array({})".format(", ".join(f"array({', '.join(map(str, order))})" for order in permutations(range(n)))))


def _walk(order: Column, cell: Column) -> Column:
    """One struct per step of ``order``: the weighted counts of a cell."""
    none = F.lit(0).cast("long")

    def step(seen: Column, filter_no: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), filter_no)
        before = cell["mask"].bitwiseAND(seen["passed"])
        fails = cell["mask"].bitwiseAND(bit) != 0
        removed = fails & (before == 0)
        counts = F.struct(
            filter_no.alias("filter"),
            F.when((before == 0) & ~fails, cell["n"]).otherwise(none).alias("kept"),
            F.when(removed, cell["n"]).otherwise(none).alias("removed"),
            F.when(fails & (before != 0), cell["n"]).otherwise(none).alias("redundant"),
            F.when(cell["mask"] == bit, cell["n"]).otherwise(none).alias("unique_fails"),
            F.when(removed, cell["good"]).otherwise(none).alias("good_lost"),
            F.when(removed, cell["toxic"]).otherwise(none).alias("toxic_lost"),
        )
        return F.struct(
            seen["passed"].bitwiseOR(bit).alias("passed"), F.concat(seen["steps"], F.array(counts)).alias("steps")
        )

    kinds = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = F.struct(F.lit(0).alias("passed"), F.array().cast(f"array<struct<filter: int, {kinds}>>").alias("steps"))
    return F.aggregate(order, start, step, lambda seen: seen["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: the counts, and the Shapley sum of the step's filter."""
    n = len(LETTERS)
    orders = _orders(n)
    gathered = materialise(
        cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")),
        "audit_cells",
    )  # 2 ** n cells a part at most

    def over_orders(cell: Column) -> Column:
        return F.flatten(F.transform(orders, lambda order: _walk(order, cell)))

    def added(a: Column, b: Column) -> Column:
        return F.struct(a["filter"].alias("filter"), *[(a[c] + b[c]).alias(c) for c in COUNTS])

    empty = F.struct(F.lit(0).alias("mask"), *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    merged = F.aggregate("cells", over_orders(empty), lambda held, cell: F.zip_with(held, over_orders(cell), added))
    sums = gathered.select("part", merged.alias("steps")).withColumn(
        "shares",
        F.transform(
            F.array(*map(F.lit, range(n))),
            lambda k: F.aggregate(
                "steps", F.lit(0).cast("long"), lambda s, x: s + F.when(x["filter"] == k, x["removed"]).otherwise(F.lit(0).cast("long"))
            ),
        ),
    )
    names = F.expr("array({})".format(", ".join(f"'{''.join(order)}'" for order in permutations(LETTERS))))
    steps = sums.select("part", "shares", F.posexplode_outer("steps").alias("at", "x"))
    return steps.select(
        "part",
        F.element_at(names, F.floor(F.col("at") / n).cast("int") + 1).alias("filter_order"),
        (F.pmod("at", F.lit(n)) + 1).cast("int").alias("step"),
        *[F.col(f"x.{c}").alias(c) for c in COUNTS],
        F.element_at("shares", F.col("x.filter") + 1).alias("shapley"),
    )
