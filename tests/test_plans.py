"""The plans that decide how the work scales."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from millrace import Facts, clean, encode, prepare
from millrace.operators.counts import top_values
from millrace.operators.dedupe import drop_duplicates_counted
from millrace.operators.ordered import ordered_fill


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_prepared_table_is_a_narrow_projection_of_the_scan(spark, table):
    text = plan(prepare(table("orders"), visualize=False).df)
    assert "Exchange" not in text and "Python" not in text and "Join" not in text
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "o_totalprice" not in schema and "o_orderkey" not in schema  # dropped columns are not read


def test_table_without_duplicates_is_not_shuffled(spark, table):
    lineitem = table("lineitem")
    assert drop_duplicates_counted(lineitem)[0] is lineitem


def test_top_values_limit_before_the_exchange(spark, table):
    text = plan(top_values(table("documents"), ["lang", "source"], 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_ordered_fill_has_one_partition_only_for_range_edges(spark, table):
    df = table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("d"))
    text = plan(ordered_fill(df, ["d"], ["o_orderkey"], rows_per_range=200))
    singles = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: SinglePartition", text)
    assert singles and all("edge" in s for s in singles)
    assert "Python" not in text


def test_text_read_back_from_scratch_is_columnar(spark, tmp_path, table):
    path = str(tmp_path / "c.csv")
    table("customer").write.option("header", True).csv(path)
    text = plan(prepare(path, spark, visualize=False).df)
    assert "Batched: true" in text and "Format: CSV" not in text


def test_stages_reuse_facts(spark, table):
    """Cleaning and encoding of an already profiled table ask for nothing twice."""
    orders = table("orders")
    facts = Facts(orders)
    facts.scan(), facts.levels(facts.columns("categorical"))
    stage = clean(orders, facts=facts)
    assert stage.df.columns == orders.columns
    assert stage.facts.known_levels().keys() == facts.known_levels().keys()
    assert set(encode(stage.df, facts=stage.facts).facts._scan) >= {"o_orderkey", "o_custkey", "o_orderdate"}


def test_facts_are_gathered_while_a_table_is_written(spark, tmp_path):
    """A table that a stage stores needs no first pass of its own, whatever was changed in it."""

    def jobs():
        return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()

    rows = [(i, f"{i / 4}", None if i % 5 else f"2024-01-{i % 28 + 1:02d}", "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, price string, day string, c string")
    before = jobs()
    facts = Facts(df).stored("t")
    assert jobs() == before + 1
    assert facts.scan() == Facts(df).scan() and facts.rows == 400
    before = jobs()
    facts.scan(), facts.nulls()
    assert jobs() == before

    stage = clean(df, missing_strategy="ffill", order_by=["k"], outlier_method="none")
    before = jobs()
    found = stage.facts.scan()  # two columns were parsed, one filled in order: nothing is left to ask
    assert jobs() == before
    assert found == Facts(stage.df).scan()


def test_row_distribution_of_one_hot_value(spark):
    """Value counts of a column with one dominating value shuffle one row of it per task."""
    df = spark.range(0, 50_000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    assert top_values(df, ["c"], 1).first()["n"] == 16_667
    text = plan(top_values(df, ["c"], 1))
    assert text.index("partial_count") < text.index("Exchange") or "partial_count" in text
