import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import Facts, encode, engineer
from millrace.operators import encode as enc
from millrace.operators import features as feat
from millrace.operators.counts import value_counts
from millrace.operators.ordered import dense_codes

TS = datetime.datetime


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_strategy_resolution():
    sizes = {"none": 0, "one": 1, "two": 2, "three": 3, "ten": 10, "eleven": 11, "listed": 2}
    assert enc.plan_kinds(sizes, listed={"listed": []}) == {
        "none": "onehot", "one": "onehot", "two": "label", "three": "onehot", "ten": "onehot", "eleven": "frequency",
        "listed": "ordinal",
    }
    assert enc.plan_kinds({"c": 5000}, "onehot") == {"c": "onehot"}


def test_any_number_of_dummies_without_a_guard(spark):
    df = frame(spark, [(f"v{i:04d}",) for i in range(60)], "c string")
    assert len(enc.onehot(df, "c", drop_first=False, guard=None).columns) == 60


def test_onehot_names_nulls_and_collisions(spark):
    df = frame(spark, [("a", 1), ("A", 2), (None, 3), ("b", 4)], "c string, c_a int")
    out = enc.onehot(df, "c", drop_first=False)
    assert out.columns == ["c_a", "c_A_1", "c_a_2", "c_b"]
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1, 0), (2, 1, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1)]
    assert enc.onehot(frame(spark, [("x",)], "c string"), "c").columns == []
    with pytest.raises(ValueError, match="onehot_guard"):
        enc.onehot(df, "c", guard=2)


def test_label_orders_by_code_point_and_counts_missing(spark):
    df = frame(spark, [("b",), ("B",), ("é",), (None,), ("b",)], "c string")
    out, mapping = enc.label(df, "c")
    assert mapping.entries == {"<NA>": 0, "B": 1, "b": 2, "é": 3}
    assert sorted(r["c"] for r in out.collect()) == [0, 1, 2, 2, 3]


def test_wide_label_equals_dense_rank(spark):
    words = [f"w{i * 7919 % 1000:04d}" if i % 50 else None for i in range(3000)]
    df = frame(spark, list(enumerate(words)), "k int, c string")
    out, mapping = enc.label(df, "c")
    assert mapping.table is not None
    order = {w: i for i, w in enumerate(sorted({w or "<NA>" for w in words}))}
    assert {r["k"]: r["c"] for r in out.collect()} == {k: order[w or "<NA>"] for k, w in enumerate(words)}


@pytest.mark.parametrize("rows_per_range", [10, 10_000])
def test_dense_codes_across_ranges(spark, rows_per_range):
    df = frame(spark, [(f"{i:03d}",) for i in range(500)], "value string").repartition(9)
    got = {r["value"]: r["code"] for r in dense_codes(df, 500, rows_per_range).collect()}
    assert got == {f"{i:03d}": i for i in range(500)}


def test_dense_codes_of_more_ranges_than_literals(spark):
    """One value per range, 4,200 of them: no bound on their number."""
    df = frame(spark, [(f"{i:04d}",) for i in range(4200)], "value string").repartition(4)
    got = {r["value"]: r["code"] for r in dense_codes(df, 4200, 1).collect()}
    assert got == {f"{i:04d}": i for i in range(4200)}


@pytest.mark.parametrize("n_bytes,n_unique", [(10, 401), (10**9, 401), (1 << 50, 1 << 44)])
def test_lookup_forms_agree(spark, n_bytes, n_unique):
    # One value holds half of all rows; some are missing, some unknown to the mapping.
    words = ["hot"] * 500 + [f"w{i}" for i in range(400)] + [None] * 50 + ["new"] * 5
    df = frame(spark, list(enumerate(words)), "k int, c string")
    mapping = value_counts(df.where("c <> 'new'"), ["c"]).select("value", "n", (F.col("n") * 2).alias("code"))
    out = enc.lookup(df, "c", F.col("c"), mapping, len(words), n_unique, n_bytes)
    want = {w: words.count(w) * 2 for w in set(words) if w not in (None, "new")}
    assert {r["k"]: r["c"] for r in out.collect()} == {k: want.get(w) for k, w in enumerate(words)}
    assert out.columns == df.columns


def test_frequency_and_ordinal(spark):
    df = frame(spark, [("a",), ("a",), ("b",), (None,)], "c string")
    assert sorted(r["c"] for r in enc.frequency(df, "c")[0].na.fill(-1).collect()) == [-1, 1 / 3, 2 / 3, 2 / 3]
    assert [r["c"] for r in enc.ordinal(df, "c", ["b", "z"])[0].collect()] == [-1.0, -1.0, 0.0, -1.0]
    assert [r["c"] for r in enc.ordinal(df, "c")[0].collect()] == [0.0, 0.0, 1.0, -1.0]


def test_encode_all_columns(spark):
    rows = [("m", "x", f"v{i % 15}", "lo", i) for i in range(15)] + [("f", "y", "v0", "hi", 99), (None, "z", "v1", "??", 7)]
    df = frame(spark, rows, "two string, three string, many string, grade string, n int")
    stage = encode(df, ordinal_categories={"grade": ["lo", "hi"]})
    log = stage.report["categorical_encoding"]
    assert {c: v["strategy"] for c, v in log.items()} == {"two": "label", "three": "onehot", "many": "frequency", "grade": "ordinal"}
    assert stage.df.columns == ["two", "many", "grade", "n", "three_y", "three_z"]
    table = enc.mapping_table(spark, stage.mappings)
    assert {r["value"]: r["code"] for r in table.where("column = 'two'").collect()} == {"<NA>": 0.0, "f": 1.0, "m": 2.0}
    everything = encode(df, encoding_strategy="label").df
    assert all(t in ("int", "bigint", "double") for _, t in everything.dtypes)
    with pytest.raises(ValueError):
        encode(df, encoding_strategy="hash")


def test_explicit_ordinal_and_onehot_for_every_column(spark):
    df = frame(spark, [(f"v{i:02d}",) for i in range(30)], "c string")
    assert len(encode(df, encoding_strategy="onehot").df.columns) == 29
    assert sorted(r["c"] for r in encode(df, encoding_strategy="ordinal").df.collect()) == [float(i) for i in range(30)]


def test_date_parts_equal_pandas(spark):
    days = pd.date_range("2023-12-25", periods=400, freq="31h")
    df = frame(spark, [(i, d.to_pydatetime()) for i, d in enumerate(days)] + [(999, None)], "k int, t timestamp_ntz")
    out, listed, _ = feat.extract_date_features(df)
    assert out.columns == ["k", "t_year", "t_month", "t_day", "t_dayofweek", "t_quarter", "t_is_weekend", "t_hour"]
    assert listed[0] == "t_hour" and len(listed) == 7
    got = out.where("k < 999").orderBy("k").toPandas()
    for part in ("year", "month", "day", "dayofweek", "quarter", "hour"):
        assert got[f"t_{part}"].tolist() == getattr(days, part).tolist()
    assert got["t_is_weekend"].tolist() == days.dayofweek.isin([5, 6]).astype(int).tolist()
    missing = out.where("k = 999").first()
    assert missing["t_year"] is None and missing["t_is_weekend"] == 0


def test_hour_only_if_it_varies_and_source_kept_on_request(spark):
    df = frame(spark, [(TS(2024, 1, 1, 5),), (TS(2024, 1, 2, 5),)], "t timestamp_ntz")
    out, listed, _ = feat.extract_date_features(df, drop_source=False)
    assert out.columns[0] == "t" and "t_hour" not in out.columns and len(listed) == 6


@pytest.mark.parametrize("rows,expected", [(10, []), (11, ["id", "name"])])
def test_identifier_guard(spark, rows, expected):
    df = frame(spark, [(i, f"n{i}", 1) for i in range(rows)], "id int, name string, one int")
    assert feat.identifier_columns(Facts(df)) == expected


def test_identifier_share_counts_null_rows(spark):
    df = frame(spark, [(i if i < 18 else None, i if i < 19 else None) for i in range(20)], "a int, b int")
    assert feat.identifier_columns(Facts(df)) == ["b"]


def test_low_variance_uses_the_deviation(spark):
    df = frame(spark, [(0.001 * i, 0.1 * i, 5.3) for i in range(10)], "tiny double, small double, flat double")
    assert feat.low_variance_columns(Facts(df)) == ["tiny", "flat"]
    assert feat.low_variance_columns(Facts(frame(spark, [(1.0,)], "a double"))) == []


def test_correlated_columns_look_at_dropped_ones_too(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    data = pd.DataFrame({"a": a, "b": a * 2 + 0.1 * rng.normal(size=300), "c": rng.normal(size=300), "flat": 0.1})
    data["d"] = data["b"] + 0.1 * rng.normal(size=300)
    df = frame(spark, [tuple(map(float, r)) for r in data.to_numpy()], ", ".join(f"{c} double" for c in data))
    assert feat.correlated_columns(Facts(df)) == ["b", "d"]


def test_engineer_switches(spark):
    df = frame(spark, [(i, TS(2024, 1, 1 + i % 28), i % 7) for i in range(40)], "id int, t timestamp_ntz, n int")
    stage = engineer(df)
    assert stage.report["identifier_columns_dropped"] == ["id"] and "t" not in stage.df.columns
    off = engineer(df, extract_date_features=False, drop_identifiers=False, drop_low_variance=False, drop_high_correlation=False)
    assert off.df.columns == df.columns and off.report == {}


def test_date_parts_replace_columns_of_their_name_in_place(spark):
    df = frame(spark, [(TS(2024, 5, 6), 1, 2, 3)], "d timestamp_ntz, D_Year int, x int, d_day int")
    out = feat.extract_date_features(df)[0]
    assert out.columns[:3] == ["d_year", "x", "d_day"] and len(set(c.lower() for c in out.columns)) == len(out.columns)
    row = out.first()
    assert (row["d_year"], row["x"], row["d_day"], row["d_month"]) == (2024, 2, 6, 5)


def test_wide_mappings_are_stored_and_joined_once(spark):
    """Without broadcast a coded column is one scan: no later job repeats its lookup."""
    df = frame(spark, [(i, f"w{i % 700}") for i in range(2000)], "k int, c string")
    keep = enc.BROADCAST_BYTES
    enc.BROADCAST_BYTES = 0
    try:
        out = enc.encode_columns(df, "frequency")[0]
    finally:
        enc.BROADCAST_BYTES = keep
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert out.where("c is null").count() == 0
