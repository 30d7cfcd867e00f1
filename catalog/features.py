"""Feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import features as feat
from millrace.operators.counts import distinct_counts
from millrace.operators.facts import Facts
from millrace.plans import stages

from .registry import ORDERS_N, orders_n, query, table


def _parts(c: str) -> str:
    return f"""year({c})::INT AS {c}_year, month({c})::INT AS {c}_month, day({c})::INT AS {c}_day, (isodow({c}) - 1)::INT AS {c}_dayofweek,
      quarter({c})::INT AS {c}_quarter, coalesce(isodow({c}) IN (6, 7), false)::INT AS {c}_is_weekend"""


@query("f1_date_parts", f"WITH {ORDERS_N} SELECT o_orderkey, {_parts('odate').replace('::INT', '::DOUBLE')} FROM orders_n")
def f1(spark, sf):
    out = feat.extract_date_features(orders_n(spark, sf).select("o_orderkey", "odate"))[0]
    return out.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]])


@query("f2_hour", f"SELECT event_id, {_parts('ts')}, hour(ts)::INT AS ts_hour FROM events")
def f2(spark, sf):
    return feat.extract_date_features(table(spark, sf, "events").select("event_id", "ts"))[0]


@query("f3_keep_datetime", f"SELECT o_orderkey, o_orderdate, {_parts('o_orderdate')} FROM orders")
def f3(spark, sf):
    return feat.extract_date_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), drop_source=False)[0]


_ID_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag"]


@query(
    "f4_identifiers",
    f"""SELECT unnest({_ID_COLUMNS}) AS "column", unnest([{", ".join(f"count(DISTINCT {c}) * 1.0 / count(*) >= 0.95" for c in _ID_COLUMNS)}]) AS dropped FROM lineitem""",
)
def f4(spark, sf):
    facts = Facts(table(spark, sf, "lineitem").select(*_ID_COLUMNS))
    gone = feat.identifier_columns(facts)
    return spark.createDataFrame([(c, c in gone) for c in _ID_COLUMNS], "column string, dropped boolean")


@query(
    "f4_distinct_shares",
    f"""SELECT unnest({_ID_COLUMNS}) AS "column", unnest([{", ".join(f"round(count(DISTINCT {c}) * 1.0 / count(*), 6)::DOUBLE" for c in _ID_COLUMNS)}]) AS share FROM lineitem""",
)
def f4_shares(spark, sf):
    df = table(spark, sf, "lineitem")
    rows = df.count()
    shares = [(c, n / rows) for c, n in distinct_counts(df, _ID_COLUMNS).items()]
    return spark.createDataFrame(shares, "column string, share double").withColumn("share", F.round("share", 6))


@query(
    "f5_low_variance",
    """SELECT unnest(['l_tax', 'l_discount', 'l_quantity', 'cents']) AS "column",
              unnest([stddev_samp(l_tax) < 0.01, stddev_samp(l_discount) < 0.01, stddev_samp(l_quantity) < 0.01, stddev_samp(l_tax / 100) < 0.01]) AS dropped,
              unnest([round(stddev_samp(l_tax), 8), round(stddev_samp(l_discount), 8), round(stddev_samp(l_quantity), 8), round(stddev_samp(l_tax / 100), 8)]) AS std FROM lineitem""",
)
def f5(spark, sf):
    df = table(spark, sf, "lineitem").select("l_tax", "l_discount", "l_quantity", (F.col("l_tax") / 100).alias("cents"))
    facts = Facts(df)
    gone = feat.low_variance_columns(facts)
    rows = [(c, c in gone, s) for c, s in facts.std(df.columns).items()]
    return spark.createDataFrame(rows, "column string, dropped boolean, std double").withColumn("std", F.round("std", 8))


_PART_NAMES = ["o_orderdate_year", "o_orderdate_month", "o_orderdate_day", "o_orderdate_dayofweek", "o_orderdate_quarter", "o_orderdate_is_weekend"]


@query(
    "f6_correlated",
    f"""WITH p AS (SELECT {_parts('o_orderdate')} FROM orders)
        SELECT unnest({_PART_NAMES}) AS "column", unnest([{", ".join("(" + (" OR ".join(f"abs(corr({a}, {b})) > 0.95" for a in _PART_NAMES[:i]) or "false") + ")" for i, b in enumerate(_PART_NAMES))}]) AS dropped FROM p""",
)
def f6(spark, sf):
    df = feat.extract_date_features(table(spark, sf, "orders").select("o_orderdate"))[0]
    gone = feat.correlated_columns(Facts(df))
    return spark.createDataFrame([(c, c in gone) for c in df.columns], "column string, dropped boolean")


@query(
    "f7_feature_report",
    f"""WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice, {_parts('o_orderdate')} FROM orders),
        c AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS "column",
                unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_totalprice)]) * 1.0 / count(*) AS share FROM p)
        SELECT 'datetime_features_extracted' AS item, unnest({_PART_NAMES}) AS "column"
        UNION ALL SELECT 'identifier_columns_dropped', "column" FROM c WHERE share >= 0.95
        UNION ALL SELECT 'high_correlation_dropped', 'o_orderdate_quarter' FROM p HAVING corr(o_orderdate_month, o_orderdate_quarter) > 0.95""",
)
def f7(spark, sf):
    report = stages.engineer(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).report
    return spark.createDataFrame([(item, c) for item, columns in report.items() for c in columns], "item string, column string")


@query("x0f_engineer", f"""SELECT o_custkey, {_parts('o_orderdate').replace("quarter(o_orderdate)::INT AS o_orderdate_quarter, ", "")} FROM orders""")
def x0f(spark, sf):
    return stages.engineer(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).df
