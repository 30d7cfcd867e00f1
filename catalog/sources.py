"""Scans and sinks: tables are written by Spark to a scratch folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import normalise
from millrace.operators.facts import Facts
from millrace.operators.profile import numeric_statistics, numeric_table, profile, summary_columns
from millrace.sources.readers import load, preview
from millrace.sources.writers import save_report, save_table, summary_table
from millrace.workspace import scratch_path

from .registry import query, table


def _stored(spark, df, name, suffix, **options):
    path = scratch_path(spark, name, suffix)
    save_table(df, path, **options)
    return path


@query(
    "s1_csv_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders",
)
def s1(spark, sf):
    orders = table(spark, sf, "orders")
    return load(spark, _stored(spark, orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string")), "s1", ".csv"))


@query("s2_tsv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s2(spark, sf):
    return load(spark, _stored(spark, table(spark, sf, "customer"), "s2", ".tsv"))


@query("s3_json_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s3(spark, sf):
    return load(spark, _stored(spark, table(spark, sf, "documents"), "s3", ".json"))


@query("s4_parquet_scan", "SELECT * FROM lineitem")
def s4(spark, sf):
    return load(spark, f"{sf}/lineitem.parquet")


@query(
    "s5_format_dispatch",
    """SELECT f.format, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, round(sum(p_retailprice), 2) AS prices
       FROM part, (VALUES ('csv'), ('tsv'), ('json'), ('parquet')) f(format) GROUP BY f.format""",
)
def s5(spark, sf):
    part = table(spark, sf, "part")
    out = None
    for fmt in ("csv", "tsv", "json", "parquet"):
        df = load(spark, _stored(spark, part, "s5", f".{fmt.upper()}", format=fmt))
        row = df.agg(
            F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.round(F.sum("p_retailprice"), 2).alias("prices")
        ).select(F.lit(fmt).alias("format"), "n", "keys", "prices")
        out = row if out is None else out.unionByName(row)
    return out


@query("s7_encoding_fallback", "SELECT c_custkey, c_name || ' - café' AS c_name FROM customer")
def s7(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" - café")).alias("c_name"))
    return load(spark, _stored(spark, names, "s7", ".csv", encoding="ISO-8859-1"))


@query("s8_nested_to_text", "SELECT vec_id, label, len(embedding) AS n_items FROM embeddings")
def s8(spark, sf):
    df = load(spark, f"{sf}/embeddings.parquet")
    return df.select("vec_id", "label", F.json_array_length("embedding").cast("bigint").alias("n_items"))


@query(
    "s9_null_tokens",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
              CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio FROM orders""",
)
def s9(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k,
        F.when(k % 11 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 13 == 0, "n/a").when(k % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("prio"),
    )
    return load(spark, _stored(spark, rows, "s9", ".csv"))


@query("s10_csv_types", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_tax, l_quantity > 25 AS big, l_returnflag FROM lineitem")
def s10(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", F.when(F.col("l_quantity") > 25, "True").otherwise("False").alias("big"), "l_returnflag"
    )
    return load(spark, _stored(spark, rows, "s10", ".csv"))


@query("s11_reader_options", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def s11(spark, sf):
    return load(spark, _stored(spark, table(spark, sf, "supplier"), "s11", ".csv", sep="|"), sep="|")


@query("s12_preview", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def s12(spark, sf):
    return preview(table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey"))


@query("k1_csv_sink", "SELECT page_id, url, html FROM pages")
def k1(spark, sf):
    # Page sources hold quotes, commas and line breaks.
    return load(spark, _stored(spark, table(spark, sf, "pages"), "k1", ".csv"))


@query("s1_csv_quoted_breaks", "SELECT page_id, chr(34) || url || chr(10) || ',' AS url, page_id % 7 AS rest FROM pages")
def s1_breaks(spark, sf):
    pages = table(spark, sf, "pages")
    url = F.concat(F.lit('"'), "url", F.lit("\n,"))
    return load(spark, _stored(spark, pages.select("page_id", url.alias("url"), (F.col("page_id") % 7).alias("rest")), "s1b", ".csv"))


@query(
    "k2_report_sink",
    """SELECT count(*) AS n_rows, CAST(5 + 1 AS BIGINT) AS n_cols, round(avg(value), 4) AS mean_value, count(DISTINCT event_type) AS n_types FROM events""",
)
def k2(spark, sf):
    path = scratch_path(spark, "k2", ".json")
    save_report(spark, {"raw_profile": profile(normalise(table(spark, sf, "events")))}, path)
    report = spark.read.json(path, multiLine=True)
    return report.select(
        F.col("raw_profile.shape.rows").alias("n_rows"),
        F.col("raw_profile.shape.cols").alias("n_cols"),
        F.col("raw_profile.numerical.value.mean").alias("mean_value"),
        F.col("raw_profile.categorical.event_type.n_unique").alias("n_types"),
    )


@query(
    "k3_summary",
    """SELECT c AS "column", round_even(min(v), 3) + 0.0 AS min, round_even(avg(v), 3) + 0.0 AS mean, round_even(quantile_cont(v, 0.5), 3) + 0.0 AS median,
              round_even(max(v), 3) + 0.0 AS max, round_even(stddev_samp(v), 3) + 0.0 AS std, round_even(skewness(v), 3) + 0.0 AS skewness, round_even(kurtosis(v), 3) + 0.0 AS kurtosis
       FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_discount', 'l_tax']) AS c,
                    unnest([l_orderkey::DOUBLE, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax]) AS v FROM lineitem)
       GROUP BY c""",
)
def k3(spark, sf):
    facts = Facts(normalise(table(spark, sf, "lineitem")))
    return summary_table(numeric_table(spark, numeric_statistics(facts, summary_columns(facts))))
