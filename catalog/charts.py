"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import charts
from millrace.operators.facts import Facts

from .profiling import _top_sql
from .registry import ORDERS_N, orders_n, query, table


@query(
    "v1_missing_pct",
    f"""WITH {ORDERS_N} SELECT unnest(['price', 'prio', 'odate']) AS "column",
        round(unnest([count(*) - count(price), count(*) - count(prio), count(*) - count(odate)]) * 100.0 / count(*), 6)::DOUBLE AS pct FROM orders_n""",
)
def v1(spark, sf):
    return charts.missing_chart(orders_n(spark, sf)).withColumn("pct", F.round("pct", 6))


@query(
    "v2_chart_columns",
    """SELECT 'user_id' AS "column" FROM events HAVING count(DISTINCT user_id) < 0.95 * count(*)
       UNION ALL SELECT 'value' FROM events HAVING count(DISTINCT value) < 0.95 * count(*)""",
)
def v2(spark, sf):
    return spark.createDataFrame([(c,) for c in charts.chart_columns(Facts(table(spark, sf, "events")))], "column string")


@query(
    "v3_histogram",
    """WITH t AS (SELECT unnest(['value', 'user_id']) AS "column", unnest([value, user_id::DOUBLE]) AS v FROM events),
            e AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM t GROUP BY "column")
       SELECT "column", least(floor((v - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM t JOIN e USING ("column") GROUP BY ALL""",
)
def v3(spark, sf):
    return charts.histogram(table(spark, sf, "events"), ["value", "user_id"])


@query(
    "v4_box",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT 'value' AS "column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
              min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
              count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_fliers FROM events, q GROUP BY q1, median, q3""",
)
def v4(spark, sf):
    out = charts.box_statistics(table(spark, sf, "events"), ["value"])
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "whisker_low", "whisker_high", "n_fliers")


@query("v5_top15", _top_sql("part", ["p_name", "p_brand", "p_type"], 15))
def v5(spark, sf):
    return charts.top_chart(table(spark, sf, "part"))


@query("v6_series", "SELECT ts, user_id, value FROM events ORDER BY ts")
def v6(spark, sf):
    return charts.time_series(table(spark, sf, "events"), "ts", ["user_id", "value"])


@query(
    "v6_series_bounded",
    """WITH e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), w AS (SELECT lo, date_sub('microsecond', lo, hi) // 100 + 1 AS wide FROM e)
       SELECT lo + to_microseconds(date_sub('microsecond', lo, ts) // wide * wide) AS ts, round(avg(value), 6) AS value FROM events, w GROUP BY 1""",
)
def v6_bounded(spark, sf):
    return charts.time_series(table(spark, sf, "events"), "ts", ["value"], max_points=100).withColumn("value", F.round("value", 6))


@query(
    "v7_monthly",
    f"""WITH {ORDERS_N} SELECT date_trunc('month', odate)::TIMESTAMP AS month, round(avg(price), 4) AS price FROM orders_n WHERE odate IS NOT NULL GROUP BY 1""",
)
def v7(spark, sf):
    return charts.monthly_mean(orders_n(spark, sf), "odate", ["price"]).withColumn("price", F.round("price", 4))


_EVENT_NUMBERS = ["event_id", "user_id", "value"]


@query(
    "v8_correlation",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 9) AS r FROM events"
        for i, a in enumerate(_EVENT_NUMBERS)
        for b in _EVENT_NUMBERS[i + 1 :]
    ),
)
def v8(spark, sf):
    return charts.correlation_table(Facts(table(spark, sf, "events"))).withColumn("r", F.round("r", 9))


@query(
    "x0v_chart_sizes",
    """SELECT 'box' AS chart, 2::BIGINT AS n FROM events HAVING count(*) > 10
       UNION ALL SELECT 'correlation', 3
       UNION ALL SELECT 'histogram', count(*) FROM (SELECT DISTINCT "column", least(floor((v - lo) / (hi - lo) * 30), 29) FROM
            (SELECT unnest(['value', 'user_id']) AS "column", unnest([value, user_id::DOUBLE]) AS v FROM events)
            JOIN (SELECT 'value' AS "column", min(value) AS lo, max(value) AS hi FROM events UNION ALL SELECT 'user_id', min(user_id), max(user_id) FROM events) USING ("column"))
       UNION ALL SELECT 'monthly:ts', count(DISTINCT date_trunc('month', ts)) FROM events
       UNION ALL SELECT 'top', (SELECT least(count(DISTINCT event_type), 15) + least(count(DISTINCT props), 15) FROM events)
       UNION ALL SELECT 'series:ts', count(*) FROM events""",
)
def x0v(spark, sf):
    out = None
    for name, df in charts.chart_data(table(spark, sf, "events")).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("chart"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "x0v_chart_contents",
    """WITH v AS (SELECT unnest(['value', 'user_id']) AS c, unnest([value, user_id::DOUBLE]) AS v, ts FROM events),
            q AS (SELECT c, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY c),
            t AS (SELECT c, w, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, w) AS place
                  FROM (SELECT unnest(['event_type', 'props']) AS c, unnest([event_type, props::VARCHAR]) AS w FROM events) WHERE w IS NOT NULL GROUP BY c, w)
       SELECT 'histogram' AS chart, c || '/' || least(floor((v - lo) / (hi - lo) * 30), 29)::INT AS item, count(*)::DOUBLE AS number FROM v JOIN q USING (c) GROUP BY 1, 2
       UNION ALL SELECT 'monthly', c || '/' || strftime(ts, '%Y-%m'), round(avg(v), 4) FROM v GROUP BY 1, 2
       UNION ALL SELECT 'top', c || '/' || w, n::DOUBLE FROM t WHERE place <= 15
       UNION ALL SELECT 'box', c || '/' || unnest(['q1', 'median', 'q3']), round(unnest([q1, q2, q3]), 4) FROM q""",
)
def x0v_contents(spark, sf):
    made = charts.chart_data(table(spark, sf, "events"))

    def tall(chart, df, item, number):
        return df.select(F.lit(chart).alias("chart"), item.alias("item"), number.cast("double").alias("number"))

    name = lambda *parts: F.concat_ws("/", *parts)
    out = tall("histogram", made["histogram"], name("column", "bin"), F.col("n"))
    out = out.unionByName(tall("top", made["top"], name("column", "value"), F.col("n")))
    for c in ("value", "user_id"):
        month = F.date_format("month", "yyyy-MM")
        out = out.unionByName(tall("monthly", made["monthly:ts"], name(F.lit(c), month), F.round(c, 4)))
    for c in ("q1", "median", "q3"):
        out = out.unionByName(tall("box", made["box"], name("column", F.lit(c)), F.round(c, 4)))
    return out
