"""Encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import encode as enc
from millrace.operators.counts import levels, value_counts
from millrace.operators.facts import Facts
from millrace.plans import stages

from .registry import ORDERS_N, orders_n, query, table

_TEXT_COLUMNS = {
    "customer": ["c_name", "c_mktsegment"],
    "part": ["p_name", "p_brand", "p_type"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
}


@query(
    "e1_cardinality",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM {t}""" for t, cs in _TEXT_COLUMNS.items() for c in cs
    ),
)
def e1(spark, sf):
    rows = [
        (c, v.n_unique) for t, columns in _TEXT_COLUMNS.items() for c, v in levels(table(spark, sf, t), columns).items()
    ]
    return spark.createDataFrame(rows, "column string, n_unique bigint")


@query(
    "e2_strategies",
    "WITH k AS ("
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n FROM {t}""" for t, cs in _TEXT_COLUMNS.items() for c in cs
    )
    + """) SELECT "column", n AS n_unique, CASE WHEN "column" = 'l_returnflag' THEN 'ordinal' WHEN n = 2 THEN 'label'
          WHEN n <= 10 THEN 'onehot' ELSE 'frequency' END AS strategy FROM k""",
)
def e2(spark, sf):
    rows = []
    for t, columns in _TEXT_COLUMNS.items():
        report = enc.encode_columns(table(spark, sf, t).select(*columns), ordinal_categories={"l_returnflag": ["N", "A", "R"]})[1]
        rows += [(c, r["n_unique"], r["strategy"]) for c, r in report.items()]
    return spark.createDataFrame(rows, "column string, n_unique bigint, strategy string")


@query(
    "e3_onehot",
    """SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::INT AS "c_mktsegment_FURNITURE",
       (c_mktsegment = 'HOUSEHOLD')::INT AS "c_mktsegment_HOUSEHOLD", (c_mktsegment = 'MACHINERY')::INT AS "c_mktsegment_MACHINERY" FROM customer""",
)
def e3(spark, sf):
    return enc.onehot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    "e3_onehot_nulls",
    f"""WITH {ORDERS_N} SELECT o_orderkey, coalesce((prio = '1-URGENT')::INT, 0) AS "prio_1-URGENT", coalesce((prio = '2-HIGH')::INT, 0) AS "prio_2-HIGH",
        coalesce((prio = '3-MEDIUM')::INT, 0) AS "prio_3-MEDIUM", coalesce((prio = '4-NOT SPECIFIED')::INT, 0) AS "prio_4-NOT SPECIFIED",
        coalesce((prio = '5-LOW')::INT, 0) AS "prio_5-LOW" FROM orders_n""",
)
def e3_nulls(spark, sf):
    return enc.onehot(orders_n(spark, sf).select("o_orderkey", "prio"), "prio", drop_first=False)


@query("e4_label", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM lineitem")
def e4(spark, sf):
    return enc.label(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus")[0]


@query(
    "e4_label_nulls",
    f"""WITH {ORDERS_N} SELECT o_orderkey, dense_rank() OVER (ORDER BY coalesce(prio, '<NA>')) - 1 AS prio FROM orders_n""",
)
def e4_nulls(spark, sf):
    return enc.label(orders_n(spark, sf).select("o_orderkey", "prio"), "prio")[0]


@query("e4_label_wide", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer")
def e4_wide(spark, sf):
    return enc.label(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name")[0]


@query(
    "e5_frequency",
    "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) * 1.0 / count(*) OVER (), 9)::DOUBLE AS p_brand FROM part",
)
def e5(spark, sf):
    out = enc.frequency(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")[0]
    return out.withColumn("p_brand", F.round("p_brand", 9))


@query(
    "e5_frequency_wide",
    "SELECT doc_id, round(count(*) OVER (PARTITION BY text) * 1.0 / count(*) OVER (), 9)::DOUBLE AS text FROM documents",
)
def e5_wide(spark, sf):
    out = enc.frequency(table(spark, sf, "documents").select("doc_id", "text"), "text")[0]
    return out.withColumn("text", F.round("text", 9))


_PRIORITIES = ["5-LOW", "3-MEDIUM", "2-HIGH"]


@query(
    "e6_ordinal",
    f"""WITH {ORDERS_N} SELECT o_orderkey, (coalesce(list_position({_PRIORITIES}, prio), 0) - 1)::DOUBLE AS prio FROM orders_n""",
)
def e6(spark, sf):
    return enc.ordinal(orders_n(spark, sf).select("o_orderkey", "prio"), "prio", _PRIORITIES)[0]


@query(
    "e7_ordinal_inferred",
    f"""WITH {ORDERS_N}, r AS (SELECT prio, dense_rank() OVER (ORDER BY prio) - 1 AS code FROM orders_n WHERE prio IS NOT NULL GROUP BY prio)
        SELECT o_orderkey, coalesce(code, -1)::DOUBLE AS prio FROM orders_n LEFT JOIN r USING (prio)""",
)
def e7(spark, sf):
    return enc.ordinal(orders_n(spark, sf).select("o_orderkey", "prio"), "prio")[0]


@query(
    "e8_mappings",
    """SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS code FROM customer GROUP BY c_mktsegment
       UNION ALL SELECT 'c_name', c_name, round(count(*) * 1.0 / sum(count(*)) OVER (), 9)::DOUBLE FROM customer GROUP BY c_name""",
)
def e8(spark, sf):
    mappings = enc.encode_columns(table(spark, sf, "customer").select("c_name", "c_mktsegment"))[2]
    return enc.mapping_table(spark, mappings).withColumn("code", F.round("code", 9))


@query("j1_lookup", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey)::DOUBLE AS customer FROM orders")
def j1(spark, sf):
    # The stated size forces the shuffle form; hot customers still go by broadcast.
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    counts = value_counts(df, ["customer"]).select("value", "n", F.col("n").cast("double").alias("code"))
    return enc.lookup(df, "customer", F.col("customer"), counts, n_rows=df.count(), n_unique=1 << 40, n_bytes=1 << 50)


@query(
    "x0e_encode",
    """SELECT p_partkey, p_size, p_retailprice, round(count(*) OVER (PARTITION BY p_name) * 1.0 / count(*) OVER (), 9)::DOUBLE AS p_name,
         round(count(*) OVER (PARTITION BY p_brand) * 1.0 / count(*) OVER (), 9)::DOUBLE AS p_brand,
         (p_type = 'MEDIUM')::INT AS "p_type_MEDIUM", (p_type = 'PROMO')::INT AS "p_type_PROMO", (p_type = 'SMALL')::INT AS "p_type_SMALL",
         (p_type = 'STANDARD')::INT AS "p_type_STANDARD", (p_type = 'LARGE')::INT AS "p_type_LARGE" FROM part""",
)
def x0e(spark, sf):
    out = stages.encode(table(spark, sf, "part")).df
    return out.withColumn("p_name", F.round("p_name", 9)).withColumn("p_brand", F.round("p_brand", 9))
