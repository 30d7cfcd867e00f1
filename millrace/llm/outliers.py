"""Robust multivariate outliers among documents, per language and source.

Statistics of the whole text are counted with built-in expressions. Transformed, they
form a vector per document. For every group of language and source a minimum
covariance determinant estimate is fitted: from a deterministic start (medians and
median deviations per coordinate), concentration steps take the half of the group
(``HALF`` of its rows, rounded up) nearest by Mahalanobis distance and estimate centre
and covariance anew, until nothing moves; so less than half of a group may be junk. A floor on the variances (``floors``) keeps the matrix regular where
most documents agree exactly, and says which differences never matter. Rows whose
distance to the reweighted estimate exceeds ``cutoff`` are rejected.

All steps are aggregations that fold before the shuffle; a group's estimate is one
row, its Cholesky factor a list of column expressions. Groups with fewer than
``least_rows`` rows are pooled per language, then over everything; rows of a pool
that is still too small are not rejected.

Defined results: null and blank texts have no words, fail the base rules and take no
part in the estimates; null languages and sources are groups of their own; repeated
rows get equal verdicts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, materialise, n_words, skew_join, words

WINDOW = 5
LEAST_ROWS = 50
STEPS = 12
# Share of a group's rows an estimate rests on; the floors keep it regular.
HALF = 0.5
# Squared distance beyond which a row is rejected: far above the 0.9999 quantile (25.7)
# of the chi-squared distribution with five degrees of freedom, for tails heavier than normal.
CUTOFF = 60.0

VECTOR = ("log_words", "word_length", "symbols", "same_lines", "repeats")
# Least standard deviation of each coordinate: differences of this order are no evidence.
FLOORS = (0.5, 0.25, 0.03, 0.1, 0.08)
PRIOR, USUAL = 30, 5


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_window_words(own: Column, width: int = WINDOW) -> Column:
    """How many words lie in runs of ``width`` words that the text holds twice or more.

    Windows are compared by a hash of their words first; where a hash repeats, windows
    are sorted by hash and words, so equal hashes of different words count apart.
    """
    n = F.size(own)
    starts = F.sequence(F.lit(0), n - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        indexed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def repeated(s: Column) -> Column:
            """Start positions of windows that equal another one."""
            size = F.size(s)

            def same(a: Column, b: Column) -> Column:
                equal = a["h"] == b["h"]
                for k in range(width):
                    equal = equal & (F.get(own, a["i"] + k) == F.get(own, b["i"] + k))
                return equal

            def twin(x: Column, k: Column) -> Column:
                before = (k > 0) & same(x, F.get(s, k - 1))
                after = (k < size - 1) & same(x, F.get(s, k + 1))
                return F.coalesce(before | after, F.lit(False))

            flagged = F.transform(s, lambda x, k: F.when(twin(x, k), x["i"]))
            return F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            """Words under windows at ascending starts, overlaps once."""
            reach = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
            step = lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(width), i + width - 1 - acc["end"])).alias("n"), (i + width - 1).alias("end")
            )
            return F.aggregate(at, reach, step, lambda acc: acc["n"])

        return _let(F.array_sort(indexed), lambda s: _let(repeated(s), total))

    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < width + 1, F.lit(0)).otherwise(counted).cast("long")


def base_statistics(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": n_words(text),
        "word_chars": F.length(F.regexp_replace(whole, SPACES, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(words(text), lambda own: repeated_window_words(own)),
    }


def vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with the transformed statistics x0, x1, ..."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [
        F.log1p(F.col("n_words").cast("double")),
        # a few words say little about their length: PRIOR words of usual length are added
        (F.col("word_chars") + PRIOR * USUAL) / (F.col("n_words") + F.lit(PRIOR)).cast("double"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        # lines that copy earlier ones, against the number of words
        F.sqrt(F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]
    return rows.withColumns({f"x{i}": v for i, v in enumerate(values)})


def _moments(p: int) -> list[Column]:
    first = [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)]
    return [F.count(F.lit(1)).alias("n_used"), *first, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)]]


def _estimate(sums: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij per row of sums; the variance floor is on the diagonal."""
    p = len(floors)
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n_used") for i in range(p)})
    out = out.withColumns(
        {
            f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n_used")
            - F.col(f"m{i}") * F.col(f"m{j}")
            + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
            for i in range(p)
            for j in range(i + 1)
        }
    )
    for j in range(p):
        square = F.col(f"c{j}{j}")
        for k in range(j):
            square = square - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        # rounding can take a hair off a regular matrix, never the floor
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(floors[j] ** 2 / 4))))
        column = {}
        for i in range(j + 1, p):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            column[f"l{i}{j}"] = rest / F.col(f"l{j}{j}")
        out = out.withColumns(column) if column else out
    keep = [f"m{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    return out.select("cell", *keep)


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    parts: list[Column] = []
    for i in range(p):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * parts[k]
        parts.append(rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for part in parts:
        total = total + part * part
    return total


def _placed(rows: DataFrame, least_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``cell`` whose estimate they are held against, and the cells' sizes."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keyed = rows.withColumns({"__l": named("lang"), "__s": named("source")})
    sizes = materialise(keyed.groupBy("__l", "__s").agg(F.count(F.lit(1)).alias("n")), "group_sizes")
    small = F.col("n") < least_rows
    by_lang = sizes.where(small).groupBy("__l").agg(F.sum("n").alias("pooled"))
    cells = sizes.join(by_lang, "__l", "left").withColumn(
        "cell",
        F.when(~small, F.concat_ws("\u0001", F.lit("s"), "__l", "__s"))
        .when(F.col("pooled") >= least_rows, F.concat_ws("\u0001", F.lit("l"), "__l"))
        .otherwise(F.lit("a")),
    )
    cells = materialise(cells.select(F.xxhash64("__l", "__s").alias("group"), "__l", "__s", "cell", "n"), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 1
    facts = cells.select("group", "cell", "n")
    placed = skew_join(keyed.withColumn("group", F.xxhash64("__l", "__s")), facts, "group", "n", total)
    sums = cells.groupBy("cell").agg(F.sum("n").alias("cell_rows"))
    return placed.drop("__l", "__s", "group", "n"), sums


def robust_distances(rows: DataFrame, floors: Sequence[float] = FLOORS, *, least_rows: int = LEAST_ROWS, steps: int = STEPS) -> DataFrame:
    """``rows`` (row, lang, source, x0, ...) with ``distance``; null where a pool is too small."""
    p = len(floors)
    names = [f"x{i}" for i in range(p)]
    placed, sizes = _placed(rows.select("row", "lang", "source", *names), least_rows)
    placed = materialise(placed.select("row", "cell", *names), "vectors")
    sizes = materialise(sizes, "cell_sizes")
    total = sizes.agg(F.sum("cell_rows")).first()[0] or 1

    def measured(estimate: DataFrame) -> DataFrame:
        facts = estimate.join(sizes, "cell")
        return skew_join(placed, facts, "cell", "cell_rows", total).select("row", "cell", *names, _distance(p).alias("d"))

    # start: medians, and median deviations scaled as for normal data
    middle = placed.groupBy("cell").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}") for i, x in enumerate(names)])
    middle = materialise(middle.join(sizes, "cell"), "medians")
    off = skew_join(placed, middle, "cell", "cell_rows", total)
    spread = off.groupBy("cell").agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10_000).alias(f"v{i}") for i, x in enumerate(names)]
    )
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"v{i}"), 2) + floors[i] ** 2).alias(f"l{i}{i}") for i in range(p)]
    zeros = [F.lit(0.0).alias(f"l{i}{j}") for i in range(p) for j in range(i)]
    estimate = materialise(
        spread.join(middle.drop("cell_rows"), "cell").select("cell", *[f"m{i}" for i in range(p)], *scale, *zeros), "estimate"
    )
    before = None
    for _ in range(steps):
        near = materialise(measured(estimate), "distances")
        limits = materialise(near.groupBy("cell").agg(F.percentile_approx("d", HALF, 10_000).alias("limit")).join(sizes, "cell"), "limits")
        inside = skew_join(near, limits, "cell", "cell_rows", total).where(F.col("d") <= F.col("limit"))
        estimate = materialise(_estimate(inside.groupBy("cell").agg(*_moments(p)), floors), "estimate")
        size = F.lit(0.0)
        for i in range(p):
            size = size + F.log(F.col(f"l{i}{i}"))
        # the determinants of all cells only fall; when their sum rests, the steps are done
        now = estimate.agg(F.sum(size)).first()[0] or 0.0
        if before is not None and abs(before - now) < 1e-6 * max(1.0, abs(now)):
            break
        before = now
    # reweighting: everything plausible under the concentrated estimate
    near = materialise(measured(estimate), "distances")
    estimate = materialise(_estimate(near.where(F.col("d") <= CUTOFF / 2).groupBy("cell").agg(*_moments(p)), floors), "estimate")
    judged = skew_join(placed, estimate.join(sizes, "cell"), "cell", "cell_rows", total)
    enough = F.col("cell_rows") >= least_rows
    return judged.select("row", F.when(enough, _distance(p)).alias("distance"))


def judge(docs: DataFrame, *, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base statistics, base_failed, kept, distance."""
    stats = base_statistics(F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", *[c.alias(k) for k, c in stats.items()])
    rows = materialise(own.withColumn("row", F.monotonically_increasing_id()), "statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    distances = robust_distances(vectors(rows.where("n_words > 0")), least_rows=least_rows)
    near = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return rows.join(distances, "row", "left").select(
        "doc_id", *stats, failed.alias("base_failed"), (~failed & near).alias("kept"), "distance"
    )
