"""Profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import normalise, ref
from millrace.operators import profile as prof
from millrace.operators.charts import correlation_table
from millrace.operators.counts import top_values
from millrace.operators.facts import Facts
from millrace.operators.missing import missing_summary
from millrace.operators.quantiles import exact_quantiles
from millrace.sources.writers import summary_table

from .registry import ORDERS_N, orders_n, query, table


@query("p1_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def p1(spark, sf):
    shape = prof.profile(table(spark, sf, "lineitem"))["shape"]
    return spark.createDataFrame([(shape["rows"], shape["cols"])], "n_rows bigint, n_cols bigint")


@query(
    "p2_types",
    """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
              unnest(['bigint', 'bigint', 'string', 'double', 'timestamp_ntz', 'string']) AS dtype FROM (SELECT count(*) FROM orders)""",
)
def p2(spark, sf):
    dtypes = prof.profile(table(spark, sf, "orders"))["dtypes"]
    return spark.createDataFrame(list(dtypes.items()), "column string, dtype string")


@query(
    "p3_missing",
    f"""WITH {ORDERS_N} SELECT unnest(['price', 'prio', 'odate']) AS "column",
        unnest([count(*) - count(price), count(*) - count(prio), count(*) - count(odate)]) AS nulls,
        round(unnest([count(*) - count(price), count(*) - count(prio), count(*) - count(odate)]) * 100.0 / count(*), 2)::DOUBLE AS pct FROM orders_n""",
)
def p3(spark, sf):
    return missing_summary(orders_n(spark, sf)).withColumn("pct", F.round("pct", 2))


@query(
    "p4_indicators",
    """SELECT unnest(['quality', 'toxic', 'doc_id']) AS "column",
         unnest([bool_and(quality IN (0, 1)), bool_and(toxic IN (0, 1)), bool_and(doc_id IN (0, 1))]) AS is_binary FROM labels""",
)
def p4(spark, sf):
    scan = Facts(table(spark, sf, "labels")).scan()
    return spark.createDataFrame([(c, s.binary) for c, s in scan.items()], "column string, is_binary boolean")


@query(
    "p5_id_like",
    """SELECT t, "column", n > 10 AND d >= 0.95 * n AS in_profile, n > 0 AND d >= 0.95 * n AS in_charts FROM (
         SELECT 'region' AS t, 'r_regionkey' AS "column", count(*) AS n, count(DISTINCT r_regionkey) AS d FROM region
         UNION ALL SELECT 'events', 'event_id', count(*), count(DISTINCT event_id) FROM events
         UNION ALL SELECT 'events', 'user_id', count(*), count(DISTINCT user_id) FROM events
         UNION ALL SELECT 'events', 'value', count(*), count(DISTINCT value) FROM events)""",
)
def p5(spark, sf):
    rows = []
    for name in ("region", "events"):
        facts = Facts(table(spark, sf, name))
        numeric = facts.columns("numeric")
        strict, loose = facts.mostly_unique(numeric, min_rows=11), facts.mostly_unique(numeric, min_rows=1)
        rows += [(name, c, strict[c], loose[c]) for c in numeric]
    return spark.createDataFrame(rows, "t string, column string, in_profile boolean, in_charts boolean")


@query(
    "p6_date_part_names",
    """SELECT 'o_custkey' AS "column" FROM orders HAVING count(DISTINCT o_custkey) < 0.95 * count(*)
       UNION ALL SELECT 'rank_month_no' FROM orders HAVING count(*) > 10""",
)
def p6(spark, sf):
    orders = table(spark, sf, "orders")
    df = orders.select("o_custkey", F.month("o_orderdate").alias("birth_month"), F.month("o_orderdate").alias("rank_month_no"))
    return spark.createDataFrame([(c,) for c in prof.summary_columns(Facts(df))], "column string")


def _numeric_sql(columns: list[str], source: str, value: str = "") -> str:
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    values = "[" + ", ".join(f"{c}::DOUBLE" for c in columns) + "]"
    return f"""SELECT c AS "column", count(v)::DOUBLE AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
      round(quantile_cont(v, 0.25), 6) AS "25%", round(quantile_cont(v, 0.5), 6) AS "50%", round(quantile_cont(v, 0.75), 6) AS "75%", max(v) AS max,
      round(coalesce(skewness(v), 0), 6) AS skewness, round(coalesce(kurtosis(v), 0), 6) AS kurtosis
      FROM (SELECT unnest({names}) AS c, unnest({values}) AS v FROM {source}) GROUP BY c"""


def _numeric(spark, df):
    facts = Facts(normalise(df))
    out = prof.numeric_table(spark, prof.numeric_statistics(facts, prof.summary_columns(facts)))
    rounded = [c for c in out.columns if c not in ("column", "count", "min", "max")]
    return out.select("column", "count", "min", "max", *[F.round(ref(c), 6).alias(c) for c in rounded])


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("p7_numeric", _numeric_sql(_LINE, "lineitem"))
def p7(spark, sf):
    return _numeric(spark, table(spark, sf, "lineitem"))


@query("p7_numeric_documents", _numeric_sql(["n_chars"], "documents"))
def p7_documents(spark, sf):
    return _numeric(spark, table(spark, sf, "documents"))


@query(
    "a7_shape_moments",
    f"""WITH {ORDERS_N}, e AS (SELECT value, 7.5 AS flat FROM events)
        SELECT 'price' AS "column", round(skewness(price), 6) AS skewness, round(kurtosis(price), 6) AS kurtosis FROM orders_n
        UNION ALL SELECT 'value', round(skewness(value), 6), round(kurtosis(value), 6) FROM e
        UNION ALL SELECT 'flat', round(coalesce(skewness(flat), 0), 6), round(coalesce(kurtosis(flat), 0), 6) FROM e""",
)
def a7(spark, sf):
    rows = []
    for df, columns in (
        (orders_n(spark, sf).select("price"), ["price"]),
        (table(spark, sf, "events").select("value", F.lit(7.5).alias("flat")), ["value", "flat"]),
    ):
        facts = Facts(df)
        facts.powers(columns)
        rows += [(c, facts.skewness(c), facts.kurtosis(c)) for c in columns]
    out = spark.createDataFrame(rows, "column string, skewness double, kurtosis double")
    return out.withColumn("skewness", F.round("skewness", 6)).withColumn("kurtosis", F.round("kurtosis", 6))


@query(
    "a8_quantiles_by_counting",
    """SELECT unnest(['l_extendedprice', 'l_quantity', 'l_partkey']) AS "column",
              unnest([round(quantile_cont(l_extendedprice, 0.1), 6), quantile_cont(l_quantity, 0.1), quantile_cont(l_partkey, 0.1)]) AS p10,
              unnest([round(quantile_cont(l_extendedprice, 0.5), 6), quantile_cont(l_quantity, 0.5), quantile_cont(l_partkey, 0.5)]) AS p50,
              unnest([round(quantile_cont(l_extendedprice, 0.99), 6), quantile_cont(l_quantity, 0.99), quantile_cont(l_partkey, 0.99)]) AS p99 FROM lineitem""",
)
def a8(spark, sf):
    df = table(spark, sf, "lineitem")
    got = exact_quantiles(df, ["l_extendedprice", "l_quantity", "l_partkey"], [0.1, 0.5, 0.99], built_in_rows=0)
    out = spark.createDataFrame([(c, *q) for c, q in got.items()], "column string, p10 double, p50 double, p99 double")
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query(
    "p8_distinct_counts",
    """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_unique FROM orders
       UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
)
def p8(spark, sf):
    summary = prof.categorical(Facts(table(spark, sf, "orders")))
    return spark.createDataFrame([(c, s["n_unique"]) for c, s in summary.items()], "column string, n_unique bigint")


def _top_sql(table_name: str, columns: list[str], k: int) -> str:
    counts = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM {table_name} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in columns
    )
    return f"""SELECT "column", value, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INT AS rank FROM ({counts})) WHERE rank <= {k}"""


@query("p9_top5_long_texts", _top_sql("documents", ["text"], 5))
def p9_long(spark, sf):
    known = Facts(table(spark, sf, "documents").select("text")).levels(["text"], 5)["text"]
    rows = [("text", v, n, i) for i, (v, n) in enumerate(known.top[:5], 1)]
    return spark.createDataFrame(rows, "column string, value string, n bigint, rank int")


@query("p9_top5", _top_sql("documents", ["lang", "source", "text"], 5))
def p9(spark, sf):
    return top_values(table(spark, sf, "documents"), ["lang", "source", "text"], 5)


@query(
    "p10_categorical_nulls",
    f"""WITH {ORDERS_N} SELECT 'prio' AS "column", count(*) - count(prio) AS missing FROM orders_n UNION ALL SELECT 'status', 0 FROM orders HAVING count(*) > 0""",
)
def p10(spark, sf):
    df = orders_n(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey")
    summary = prof.categorical(Facts(df.select("prio", "status")))
    return spark.createDataFrame([(c, s["missing"]) for c, s in summary.items()], "column string, missing bigint")


@query(
    "p11_temporal",
    f"""WITH {ORDERS_N}, a AS (SELECT 'ts' AS "column", min(ts) AS lo, max(ts) AS hi, count(*) - count(ts) AS missing FROM events
          UNION ALL SELECT 'odate', min(odate), max(odate), count(*) - count(odate) FROM orders_n)
        SELECT "column", strftime(lo, '%Y-%m-%d %H:%M:%S') AS min, strftime(hi, '%Y-%m-%d %H:%M:%S') AS max, date_sub('day', lo, hi) AS range_days, missing FROM a""",
)
def p11(spark, sf):
    rows = []
    for df in (table(spark, sf, "events"), orders_n(spark, sf)):
        summary = prof.temporal(Facts(df))
        rows += [(c, s["min"][:19], s["max"][:19], s["range_days"], s["missing"]) for c, s in summary.items()]
    return spark.createDataFrame(rows, "column string, min string, max string, range_days bigint, missing bigint")


@query(
    "r1_rounding",
    """SELECT l_orderkey || '/' || l_linenumber AS "column", round_even(l_extendedprice / 7, 3) AS mean, round_even(l_quantity * l_tax, 3) + 0.0 AS std FROM lineitem""",
)
def r1(spark, sf):
    """The rounding of the summary sink, on as many rows as there are line items."""
    name = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("column")
    mean, std = F.col("l_extendedprice") / 7, F.col("l_quantity") * F.col("l_tax")
    return summary_table(table(spark, sf, "lineitem").select(name, mean.alias("mean"), std.alias("std")))


_WIDE = {f"w{i:02d}": f"l_extendedprice * {i + 1} + l_quantity * {(i * 7) % 13} - l_partkey % {i + 2}" for i in range(13)}
_WIDE_PAIRS = [(a, b) for a in _WIDE for b in _WIDE if a < b]


@query(
    "a9_correlation_wide",
    "WITH w AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem)\n"
    + "\nUNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 8) AS r FROM w" for a, b in _WIDE_PAIRS),
)
def a9_wide(spark, sf):
    """More pairs than plain aggregate expressions serve."""
    wide = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()])
    return correlation_table(Facts(wide)).withColumn("r", F.round("r", 8))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(
    "a9_correlation",
    "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a, b in _CORR_PAIRS
    ),
)
def a9(spark, sf):
    got = Facts(table(spark, sf, "lineitem").select(*_CORR)).pearson(_CORR)
    out = spark.createDataFrame([(a, b, r) for (a, b), r in got.items()], "column_a string, column_b string, r double")
    return out.withColumn("r", F.round("r", 9))


@query(
    "a9_correlation_nulls",
    f"""WITH {ORDERS_N}, n AS (SELECT price, date_diff('day', TIMESTAMP '1990-01-01', odate)::DOUBLE AS days, o_orderkey AS k FROM orders_n)
        SELECT 'price' AS column_a, 'days' AS column_b, round(corr(price, days), 9) AS r FROM n
        UNION ALL SELECT 'price', 'k', round(corr(price, k), 9) FROM n UNION ALL SELECT 'days', 'k', round(corr(days, k), 9) FROM n""",
)
def a9_nulls(spark, sf):
    df = orders_n(spark, sf).select("price", F.expr("double(timestampdiff(DAY, timestamp_ntz'1990-01-01', odate))").alias("days"), F.col("o_orderkey").alias("k"))
    got = Facts(df).pearson(["price", "days", "k"])
    out = spark.createDataFrame([(a, b, r) for (a, b), r in got.items()], "column_a string, column_b string, r double")
    return out.withColumn("r", F.round("r", 9))


@query(
    "x0p_profile",
    """SELECT 'shape' AS section, 'rows' AS item, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'shape', 'cols', '6'
       UNION ALL SELECT 'categorical', 'o_orderstatus', count(DISTINCT o_orderstatus)::VARCHAR FROM orders
       UNION ALL SELECT 'categorical', 'o_orderpriority', count(DISTINCT o_orderpriority)::VARCHAR FROM orders
       UNION ALL SELECT 'numerical', 'o_custkey', count(o_custkey)::VARCHAR FROM orders HAVING count(DISTINCT o_custkey) < 0.95 * count(*)
       UNION ALL SELECT 'temporal', 'o_orderdate', date_sub('day', min(o_orderdate), max(o_orderdate))::VARCHAR FROM orders""",
)
def x0p(spark, sf):
    p = prof.profile(table(spark, sf, "orders"))
    rows = [("shape", k, str(v)) for k, v in p["shape"].items()]
    rows += [("categorical", c, str(s["n_unique"])) for c, s in p["categorical"].items()]
    rows += [("numerical", c, str(int(s["count"]))) for c, s in p["numerical"].items()]
    rows += [("temporal", c, str(s["range_days"])) for c, s in p["temporal"].items()]
    return spark.createDataFrame(rows, "section string, item string, value string")
