"""Mixing sources to target weights by entropy balancing.

Tokens are the units: a token of document d gets the weight ``exp(lambda_source +
theta * z_d)``, the distribution closest (in relative entropy) to the corpus that
meets the token constraints. ``lambda`` makes each source meet its target exactly;
``z`` is the standardised log length and ``theta`` keeps the token-weighted mean of z
at the corpus' own value while sources of other lengths gain or lose weight. That
one constraint is soft (``ridge``), as the targets may leave it no solution. Rates
are bounded by ``most``; the dual stays convex, flat beyond the bound. It is solved
by Newton steps over a histogram (source, size): each step is an aggregation with
map-side folding, the source duals form a table and only scalars reach the driver.

Rates become copies by error diffusion: documents of a source, largest first, in
groups of bounded size; a document gets the floor or the ceiling of its rate,
whichever keeps the taken words nearest to the wanted ones.

Defined results: null texts and texts without a word have size 0 and no copies
counted (``taken`` 0); null sources are one source, the last; repeated rows are rows
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import empty_like, mark_maybe, materialise, n_words, skew_join

MOST = 3.0
WEIGHTS = (5.0, 2.0, 1.0)
GROUP_ROWS = 2000
# Of equal rows this many go to one group at most.
LOT_ROWS = 100
SCHEMA = "doc_id long, size long, source_size long, target double, rate double, copies long, taken long"


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Sources in code point order, null last, take ``weights`` in turn and share all
    tokens. A target stops at ``most`` times its source's size; what is over goes to
    the others by weight. So a target is ``min(most * size, level * weight)``, and the
    level follows from the sources in the order in which a rising level stops them.
    One row per source: the windows below see the table of sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(listed, (turn + 1).cast("int")))
    stops = F.lit(most) * F.col("source_size") / F.col("weight")
    before = Window.orderBy("stop", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("stop", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("stop", stops)
        .withColumn("all", F.sum("source_size").over(whole))
        # the level if this source and all that stop later share what the earlier ones leave
        .withColumn("left", F.col("all") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("free", F.col("level") <= F.col("stop"))
    )
    level = F.min(F.when(F.col("free"), F.struct("stop", "level"))).over(whole)["level"]
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(level, F.lit(math.inf)) * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _newton(histogram: DataFrame, sources: DataFrame, most: float, ridge: float, steps: int) -> tuple[DataFrame, float]:
    """The duals: a table (source, lam) and theta. ``histogram``: source_key, size, z, tokens."""
    cap = math.log(most)
    # A source at its bound takes every document ``most`` times; the others start at their uniform rate.
    duals = materialise(
        sources.where("source_size > 0").select(
            "source_key",
            "target",
            "source_size",
            (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
            F.least(F.log(F.col("target") / F.col("source_size")), F.lit(cap)).alias("lam"),
        ),
        "duals",
    )
    totals = histogram.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("z")).alias("m")).first()
    theta, moment, weight = 0.0, totals["m"] or 0.0, ridge * (totals["t"] or 1.0)
    for _ in range(steps):
        u = F.when(F.col("full"), F.lit(cap)).otherwise(F.col("lam") + F.lit(theta) * F.col("z"))
        mass = F.col("tokens") * F.exp(F.least(u, F.lit(cap)))
        slope = F.when((u < cap) & ~F.col("full"), mass).otherwise(0.0)
        sums = (
            histogram.join(duals, "source_key")
            .groupBy("source_key")
            .agg(
                F.sum(mass).alias("w"),
                F.sum(slope).alias("h"),
                F.sum(mass * F.col("z")).alias("wz"),
                F.sum(slope * F.col("z")).alias("hz"),
                F.sum(slope * F.col("z") * F.col("z")).alias("hzz"),
            )
        )
        state = materialise(duals.join(sums, "source_key"), "newton")
        free = (~F.col("full")) & (F.col("h") > 0)
        gap = F.col("w") - F.col("target")
        schur = state.agg(
            F.sum("wz").alias("wz"),
            F.sum(F.when(free, F.col("hzz") - F.col("hz") * F.col("hz") / F.col("h")).otherwise(0.0)).alias("curve"),
            F.sum(F.when(free, F.col("hz") / F.col("h") * gap).otherwise(0.0)).alias("shift"),
            F.max(F.when(free, F.abs(gap) / F.greatest("target", F.lit(1.0))).otherwise(0.0)).alias("worst"),
        ).first()
        # gradient in theta after the source duals are eliminated
        pull = (schur["wz"] - moment) + weight * theta - schur["shift"]
        move = -pull / (schur["curve"] + weight)
        move = max(-0.5, min(0.5, move))
        step = (F.lit(-1.0) * gap - F.col("hz") * F.lit(move)) / F.col("h")
        lam = F.when(free, F.col("lam") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))).otherwise(F.col("lam"))
        duals = state.select("source_key", "target", "source_size", "full", lam.alias("lam"))
        theta += move
        if abs(move) < 1e-9 and schur["worst"] < 1e-9:
            break
        duals = materialise(duals, "duals")
    return duals.select("source_key", "full", F.round("lam", 6).alias("lam")), round(theta, 6)


def _copies(most: float):
    def diffuse(group: pd.DataFrame) -> pd.DataFrame:
        order = ["size", "doc_id", "tie"]
        group = group.sort_values(order, ascending=[False, True, True], na_position="last", kind="stable")
        # equal rows came folded
        group = group.loc[group.index.repeat(group["times"])]
        sizes, rates = group["size"].to_numpy(), group["rate"].to_numpy()
        low = np.floor(np.minimum(rates, most) + 1e-12)
        high = np.minimum(np.ceil(np.minimum(rates, most) - 1e-12), math.ceil(most))
        copies = np.zeros(len(group), np.int64)
        owed = 0.0
        for i, (size, rate, least, top) in enumerate(zip(sizes.tolist(), rates.tolist(), low.tolist(), high.tolist())):
            owed += size * rate
            n = least if not size or owed < (least + 0.5) * size else top
            copies[i] = n
            owed -= n * size
        return group.assign(copies=copies)[["doc_id", "source_key", "size", "rate", "copies", "row"]]

    return diffuse


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST,
    ridge: float = 1e-3,
    steps: int = 30,
    row: str | None = None,
) -> DataFrame:
    """Rates and copies of every row of ``docs``.

    Returns doc_id, size, source_size, target, rate, copies, taken and, if ``row``
    names a column of ``docs``, that column.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # null is a source of its own: its key differs from that of every name
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
        (F.col(row) if row else F.lit(None).cast("string")).alias("row"),
    )
    rows = materialise(own, "sizes")
    counted = rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = materialise(counted.withColumn("tokens", (F.col("n") * F.col("size")).cast("double")), "histogram")
    sums = histogram.groupBy("source_key").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows")
    )
    named = materialise(
        sums.withColumn("source", F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)"))), "sources"
    )
    total = named.agg(F.sum("rows")).first()[0]
    if not total:
        return empty_like(spark, SCHEMA + (f", {row} {dict(docs.dtypes)[row]}" if row else ""))
    shares = source_targets(named.select("source", "source_size"), weights, most)
    sources = materialise(
        named.join(shares.drop("source_size"), named["source"].eqNullSafe(shares["source"])).select(
            "source_key", "source_size", "rows", "target"
        ),
        "targets",
    )
    spread = histogram.agg(
        F.sum("tokens").alias("t"),
        F.sum(F.col("tokens") * F.log1p("size")).alias("s"),
        F.sum(F.col("tokens") * F.log1p("size") * F.log1p("size")).alias("q"),
    ).first()
    mean = (spread["s"] or 0.0) / (spread["t"] or 1.0)
    deviation = math.sqrt(max((spread["q"] or 0.0) / (spread["t"] or 1.0) - mean * mean, 0.0)) or 1.0
    mean, deviation = round(mean, 6), round(deviation, 6) or 1.0
    z = (F.log1p("size") - F.lit(mean)) / F.lit(deviation)
    cells = materialise(histogram.where("tokens > 0").withColumn("z", z).select("source_key", "z", "tokens"), "cells")
    duals, theta = _newton(cells, sources, most, ridge, steps)
    facts = sources.join(duals, "source_key", "left")
    facts = materialise(facts, "facts")
    joined = skew_join(rows, facts, "source_key", "rows", total)
    tilt = F.when(F.col("full"), F.lit(most)).otherwise(
        F.least(F.exp(F.coalesce("lam", F.lit(0.0)) + F.lit(theta) * z), F.lit(most))
    )
    rated = joined.withColumn("rate", F.when(F.col("size") > 0, tilt).otherwise(F.lit(1.0)))
    # a hot source is dealt out over groups of about GROUP_ROWS documents; equal rows fold first and are dealt in lots
    alike = ["doc_id", "source_key", "size", "tie", "rate", "row"]
    lots = rated.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.first("rows").alias("rows"))
    lots = lots.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT_ROWS))))
    times = F.least(F.col("n") - F.col("lot") * LOT_ROWS, F.lit(LOT_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "tie", "lot"), F.ceil(F.col("rows") / GROUP_ROWS))
    kind = dict(rows.dtypes)["row"]
    copied = (
        lots.select(*alike, times.alias("times"), salt.alias("salt"))
        .groupBy("source_key", "salt")
        .applyInPandas(
            _copies(most), f"doc_id long, source_key string, size long, rate double, copies long, row {kind}"
        )
    )
    out = skew_join(copied, facts.select("source_key", "source_size", "target", "rows"), "source_key", "rows", total)
    columns = ["doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")]
    return out.select(*columns, *([F.col("row").alias(row)] if row else []))


def take_copies(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it.

    Rows equal in id, source and text share what their kind takes. Rows that the mix
    surely does not take are left behind before the shuffle.
    """
    key = {
        "__mr_id": F.col("doc_id").cast("long"),
        "__mr_tie": F.xxhash64(F.coalesce("text", F.lit(""))),
        "__mr_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
    }
    own = docs.withColumns(key)
    mixed = mix(own.withColumn("__mr_key", F.struct(*key)), row="__mr_key", **settings)
    taken = mixed.where("copies > 0").groupBy("__mr_key").agg(F.sum("copies").alias("__mr_copies"))
    taken = materialise(taken.select("__mr_key.*", "__mr_copies"), "taken")
    names = list(key)
    marked = mark_maybe(own, taken.select(*names), names, "__mr_maybe").where("__mr_maybe").drop("__mr_maybe")
    rights = taken.withColumnsRenamed({n: f"{n}_taken" for n in names})
    same = [marked[n].eqNullSafe(rights[f"{n}_taken"]) for n in names]
    joined = marked.join(rights, same).dropDuplicates(names)
    repeated = joined.withColumn("__mr_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__mr_copies")))
    return repeated.select(*docs.columns)
