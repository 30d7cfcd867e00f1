"""Cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import infer, missing, outliers
from millrace.operators.dedupe import drop_duplicates, drop_duplicates_counted
from millrace.operators.facts import Facts
from millrace.operators.ordered import ordered_fill
from millrace.plans.stages import clean

from .registry import ORDERS_N, ORDERS_TEXT, orders_n, orders_text, query, table


@query("c1_dedupe", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def c1(spark, sf):
    return drop_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(
    "c1_dedupe_counted",
    """WITH twice AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P'),
            once AS (SELECT DISTINCT * FROM twice)
       SELECT (SELECT count(*) FROM twice) AS rows_before,
              (SELECT count(*) FROM twice) - (SELECT count(*) FROM once) AS removed,
              (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM once) AS keys_left""",
)
def c1_counted(spark, sf):
    orders = table(spark, sf, "orders")
    unique, before, removed = drop_duplicates_counted(orders.unionByName(orders.where("o_orderstatus = 'P'")))
    return unique.agg(F.sum("o_orderkey").alias("keys_left")).select(
        F.lit(before).cast("bigint").alias("rows_before"), F.lit(removed).cast("bigint").alias("removed"), "keys_left"
    )


@query("c2_infer_numeric", f"WITH {ORDERS_TEXT} SELECT o_orderkey, TRY_CAST(price AS DOUBLE) AS price FROM orders_text")
def c2(spark, sf):
    return infer.infer_types(orders_text(spark, sf).select("o_orderkey", "price"))[0]


@query("c3_infer_datetime", f"WITH {ORDERS_TEXT} SELECT o_orderkey, TRY_CAST(odate AS TIMESTAMP) AS odate FROM orders_text")
def c3(spark, sf):
    return infer.infer_types(orders_text(spark, sf).select("o_orderkey", "odate"))[0]


@query(
    "c3_infer_formats",
    """SELECT o_orderkey, o_orderdate + (o_orderkey % 20) * INTERVAL 1 HOUR AS odate FROM orders""",
)
def c3_formats(spark, sf):
    k = F.col("o_orderkey")
    at = F.expr("o_orderdate + make_dt_interval(0, int(o_orderkey % 20))")
    clock = F.date_format(at, "HH:mm:ss")
    day = F.concat(
        F.when(k % 5 == 0, F.date_format(at, "M/d/yyyy"))
        .when(k % 5 == 1, F.date_format(at, "yyyy-MM-dd"))
        .when(k % 5 == 2, F.date_format(at, "d MMMM yyyy"))
        .when(k % 5 == 3, F.date_format(at, "MMM d, yyyy"))
        .otherwise(F.date_format(at, "yyyy/MM/dd")),
        F.lit(" "),
        clock,
    )
    return infer.infer_types(table(spark, sf, "orders").select(k, day.alias("odate")))[0]


@query(
    "c3_infer_short_formats",
    """SELECT o_orderkey, date_trunc(CASE WHEN o_orderkey % 11 IN (4, 5) THEN 'month' ELSE 'day' END, o_orderdate)
              + CASE WHEN o_orderkey % 11 IN (3, 9, 10) THEN 15 ELSE 0 END * INTERVAL 1 HOUR AS odate FROM orders""",
)
def c3_short(spark, sf):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    forms = [
        "MM/dd/yy", "M-d-yy", "d MMM yy", "yyyy-MM-dd '03:00 PM'", "MMM yyyy", "MMMM yyyy", "E MMM d yyyy",
        "EEEE, MMMM d, yyyy", "'Thu' d MMM yyyy", "yyyyMMdd'T150000'", "E, d MMM yyyy '15:00:00 +0000'",
    ]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k % 11 == i, F.date_format(at, form)).otherwise(text)
    return infer.infer_types(table(spark, sf, "orders").select(k, text.alias("odate")))[0]


@query(
    "c4_drop_columns",
    f"""WITH {ORDERS_N}, s AS (SELECT o.*, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS sparse FROM orders_n o),
             f AS (SELECT unnest(['o_orderkey', 'price', 'prio', 'odate', 'sparse']) AS "column",
                          unnest([count(o_orderkey), count(price), count(prio), count(odate), count(sparse)]) AS present, count(*) AS n FROM s)
        SELECT "column", round(1.0 - present::DOUBLE / n, 6) AS null_share, 1.0 - present::DOUBLE / n > 0.5 AS dropped FROM f""",
)
def c4(spark, sf):
    df = orders_n(spark, sf).withColumn("sparse", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")))
    facts = Facts(df)
    gone = missing.high_missing_columns(facts, 0.5)
    rows = [(c, n / facts.rows, c in gone) for c, n in facts.nulls().items()]
    return spark.createDataFrame(rows, "column string, null_share double, dropped boolean").withColumn(
        "null_share", F.round("null_share", 6)
    )


@query(
    "c5_null_counts",
    f"""WITH {ORDERS_N} SELECT unnest(['price', 'prio', 'odate']) AS "column",
        unnest([count(*) - count(price), count(*) - count(prio), count(*) - count(odate)]) AS nulls FROM orders_n""",
)
def c5(spark, sf):
    return missing.missing_summary(orders_n(spark, sf)).select("column", "nulls")


_FFILL = "last_value(odate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BFILL = "first_value(odate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_MODE = "(SELECT prio FROM orders_n WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)"


@query(
    "c6_fill_auto",
    f"""WITH {ORDERS_N} SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM orders_n)) AS price,
        coalesce(prio, {_MODE}) AS prio, {_FFILL} AS odate FROM orders_n""",
)
def c6(spark, sf):
    return missing.fill_missing(orders_n(spark, sf), "auto", order_by=["o_orderkey"])[0]


@query("c7_drop_rows", f"WITH {ORDERS_N} SELECT * FROM orders_n WHERE price IS NOT NULL AND prio IS NOT NULL AND odate IS NOT NULL")
def c7(spark, sf):
    return missing.fill_missing(orders_n(spark, sf), "drop")[0]


@query(
    "c7_drop_report",
    f"""WITH {ORDERS_N} SELECT unnest(['price', 'prio', 'odate']) AS "column", unnest([
          count(*) FILTER (price IS NULL), count(*) FILTER (price IS NOT NULL AND prio IS NULL),
          count(*) FILTER (price IS NOT NULL AND prio IS NOT NULL AND odate IS NULL)]) AS n FROM orders_n""",
)
def c7_report(spark, sf):
    report = missing.fill_missing(orders_n(spark, sf), "drop")[1]
    return spark.createDataFrame(list(report.items()), "column string, n bigint")


@query(
    "c8_mean_fill",
    f"WITH {ORDERS_N} SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM orders_n)), 4) AS price FROM orders_n",
)
def c8(spark, sf):
    out = missing.fill_mean(orders_n(spark, sf).select("o_orderkey", "price"), ["price"])
    return out.withColumn("price", F.round("price", 4))


@query(
    "c9_median_fill",
    f"WITH {ORDERS_N} SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM orders_n)) AS price FROM orders_n",
)
def c9(spark, sf):
    return missing.fill_median(orders_n(spark, sf).select("o_orderkey", "price"), ["price"])


@query("c10_mode_fill", f"WITH {ORDERS_N} SELECT o_orderkey, coalesce(prio, {_MODE}) AS prio FROM orders_n")
def c10(spark, sf):
    return missing.fill_mode(orders_n(spark, sf).select("o_orderkey", "prio"), ["prio"])


@query("c11_ffill", f"WITH {ORDERS_N} SELECT o_orderkey, {_FFILL} AS odate FROM orders_n")
def c11(spark, sf):
    df = orders_n(spark, sf).select("o_orderkey", "odate")
    return ordered_fill(df, ["odate"], ["o_orderkey"], "forward", rows_per_range=2000)


@query("c12_bfill", f"WITH {ORDERS_N} SELECT o_orderkey, {_BFILL} AS odate FROM orders_n")
def c12(spark, sf):
    df = orders_n(spark, sf).select("o_orderkey", "odate")
    return ordered_fill(df, ["odate"], ["o_orderkey"], "backward", rows_per_range=2000)


@query("c13_constant_fill", f"WITH {ORDERS_N} SELECT o_orderkey, coalesce(price, -1.5) AS price, coalesce(prio, 'none') AS prio FROM orders_n")
def c13(spark, sf):
    df = missing.fill_constant(orders_n(spark, sf).select("o_orderkey", "price", "prio"), ["price"], -1.5)
    return missing.fill_constant(df, ["prio"], "none")


_BOUNDS = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
  b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query("c14_iqr_bounds", f"WITH {_BOUNDS} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")
def c14(spark, sf):
    lo, hi = outliers.iqr_bounds(Facts(table(spark, sf, "events").select("value")), ["value"])["value"]
    return spark.createDataFrame([(lo, hi)], "lo double, hi double").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_ZSCORE = """m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events),
  z AS (SELECT min(value) AS lo, max(value) AS hi FROM events, m WHERE abs((value - m.m) / m.s) < 3)"""


@query("c15_zscore_bounds", f"WITH {_ZSCORE} SELECT lo, hi FROM z")
def c15(spark, sf):
    lo, hi = outliers.zscore_bounds(Facts(table(spark, sf, "events").select("value")), ["value"])["value"]
    return spark.createDataFrame([(lo, hi)], "lo double, hi double")


@query("c15_zscore_clip", f"WITH {_ZSCORE} SELECT event_id, greatest(least(value, z.hi), z.lo) AS value FROM events, z")
def c15_clip(spark, sf):
    return outliers.handle_outliers(table(spark, sf, "events").select("event_id", "value"), "zscore", "clip", columns=["value"])[0]


@query(
    "c16_iqr_clip",
    f"WITH {_BOUNDS} SELECT event_id, round(greatest(least(value, b.hi), b.lo), 6) AS value FROM events, b",
)
def c16(spark, sf):
    out = outliers.handle_outliers(table(spark, sf, "events").select("event_id", "value"), "iqr", "clip", columns=["value"])[0]
    return out.withColumn("value", F.round("value", 6))


@query(
    "c17_iqr_remove",
    f"""WITH {_BOUNDS},
        one AS (SELECT event_id, value, value * value AS v2 FROM events, b WHERE value BETWEEN b.lo AND b.hi),
        q2 AS (SELECT quantile_cont(v2, 0.25) AS q1, quantile_cont(v2, 0.75) AS q3 FROM one)
        SELECT event_id, value, v2 FROM one, q2 WHERE v2 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def c17(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("v2"))
    return outliers.handle_outliers(df, "iqr", "remove", columns=["value", "v2"])[0]




@query(
    "c18_outlier_counts",
    """WITH tall AS (SELECT unnest(['n_chars', 'doc_id']) AS "column", unnest([n_chars::DOUBLE, doc_id::DOUBLE]) AS v FROM documents
         UNION ALL SELECT 'value', value FROM events UNION ALL SELECT 'user_id', user_id FROM events),
       q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM tall GROUP BY "column")
       SELECT "column", count(*) AS n FROM tall JOIN q USING ("column")
       WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY "column" """,
)
def c18(spark, sf):
    counted = {}
    for name, columns in (("documents", ["n_chars", "doc_id"]), ("events", ["value", "user_id"])):
        facts = Facts(table(spark, sf, name).select(*columns))
        counted.update(outliers.outlier_counts(facts, outliers.outlier_bounds(facts, columns)))
    return spark.createDataFrame(list(counted.items()), "column string, n bigint")


@query(
    "c20_cleaning_report",
    f"""WITH {ORDERS_N}, s AS (SELECT o.*, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS sparse FROM orders_n o),
        p AS (SELECT coalesce(price, (SELECT quantile_cont(price, 0.5) FROM s)) AS price FROM s),
        q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM p)
        SELECT 'duplicates_removed' AS item, '' AS "column", (SELECT count(*) FROM s WHERE prio IS NULL) AS n
        UNION ALL SELECT 'columns_dropped_high_missing', 'sparse', 1
        UNION ALL SELECT 'missing_values_filled', unnest(['price', 'prio', 'odate']),
               unnest([count(*) - count(price), count(*) - count(prio), count(*) - count(odate)]) FROM s
        UNION ALL SELECT 'outliers_handled', 'price', n FROM (SELECT count(*) AS n FROM p, q
               WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) WHERE n > 0""",
)
def c20(spark, sf):
    df = orders_n(spark, sf).withColumn("sparse", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")))
    report = clean(df.unionByName(df.where("prio IS NULL")), order_by=["o_orderkey"]).report
    rows = [("duplicates_removed", "", report["duplicates_removed"])]
    rows += [("columns_dropped_high_missing", c, 1) for c in report["columns_dropped_high_missing"]]
    for item in ("missing_values_filled", "outliers_handled"):
        rows += [(item, c, n) for c, n in report[item].items()]
    return spark.createDataFrame(rows, "item string, column string, n bigint")
