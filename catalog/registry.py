"""Query registry, table access and the derived inputs both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# orders with some values taken out: price, priority and date have nulls.
ORDERS_N = """orders_n AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS prio,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS odate
  FROM orders)"""


def orders_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k,
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("prio"),
        F.when(k % 17 != 0, F.col("o_orderdate")).alias("odate"),
    )


# Text form of price and date, every tenth row unreadable.
ORDERS_TEXT = """orders_text AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
         CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE CAST(o_orderdate AS VARCHAR) END AS odate
  FROM orders)"""


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k,
        F.when(k % 10 == 0, "x").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 10 == 0, "x").otherwise(F.col("o_orderdate").cast("string")).alias("odate"),
    )
