import datetime
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace import Facts, chart_data, profile
from millrace.operators import charts, correlate
from millrace.operators.counts import distinct_share_reaches, levels, long_text_levels
from millrace.operators import quantiles
from millrace.operators.quantiles import exact_quantiles

TS = datetime.datetime
PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def series(spark, values, schema="v double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], schema)


def check_quantiles(spark, values):
    got = exact_quantiles(series(spark, values), ["v"], PROBS, built_in_rows=0)["v"]
    want = np.quantile([v for v in values if v is not None], PROBS)
    np.testing.assert_allclose(got, want, rtol=1e-12)


rng = np.random.default_rng(9)
SHAPES = {
    "normal": rng.normal(size=5000),
    "two far ends": np.concatenate([rng.normal(size=5000), [1e300, -1e300]]),
    "log uniform": 10.0 ** rng.uniform(-200, 100, 5000),
    "one hot value": np.concatenate([np.full(4000, 3.25), rng.normal(size=2000)]),
    "constant": np.full(2000, -7.5),
    "whole": rng.integers(0, 10**9, 4000),
    "near one point": 1.0 + rng.random(3000) * 1e-13,
    "single": np.array([4.0]),
    "extremes": np.concatenate([np.full(1500, -1.7e308), np.full(1500, 1.7e308), rng.normal(size=10)]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_by_counting_equal_numpy(spark, shape):
    check_quantiles(spark, SHAPES[shape].tolist())


def test_quantiles_with_infinities_and_nulls(spark):
    values = [None] * 50 + [-math.inf] * 100 + list(range(2000)) + [math.inf] * 300
    got = exact_quantiles(series(spark, values), ["v"], [0.0, 0.25, 0.5, 1.0], built_in_rows=0)["v"]
    present = sorted(v for v in values if v is not None)
    n = len(present) - 1
    want = [present[0], None, None, present[-1]]
    for i, p in ((1, 0.25), (2, 0.5)):
        low, high = present[math.floor(n * p)], present[math.ceil(n * p)]
        want[i] = low + (high - low) * (n * p % 1)
    assert got == pytest.approx(want)
    assert exact_quantiles(series(spark, [math.inf] * 5), ["v"], [0.5], built_in_rows=0)["v"] == [math.inf]
    assert exact_quantiles(series(spark, [None, None]), ["v"], [0.5])["v"] == [None]


def test_quantile_passes(spark, monkeypatch):
    """All columns are counted in one pass over the rows; small integers need no second one."""
    passes = []
    for name in ("_counted", "_read"):
        run = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda rows, ranges, run=run, name=name: passes.append(name) or run(rows, ranges))
    df = spark.range(200_000).select((F.col("id") % 1000).alias("a"), (F.col("id") % 7 / 100).alias("b"), F.sqrt("id").alias("c"))
    whole = exact_quantiles(df, ["a", "b"], [0.25, 0.5], built_in_rows=0)
    assert whole == {"a": [249.75, 499.5], "b": [0.01, 0.03]} and passes == ["_counted"]
    passes.clear()
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0], built_in_rows=0)
    assert got["c"] == [0.0, (math.sqrt(99_999) + math.sqrt(100_000)) / 2, math.sqrt(199_999)] and passes == ["_counted", "_read"]
    passes.clear()
    monkeypatch.setattr(quantiles, "READ", 0)
    assert exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0], built_in_rows=0) == got
    assert "_read" not in passes and len(passes) <= 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    # Repeats push the ranges past the size at which values are listed one by one.
    check_quantiles(spark, values * 30)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 50])
def test_shape_moments_equal_pandas(spark, n):
    values = (rng.exponential(size=n) * 100).tolist()
    facts, want = Facts(series(spark, values)), pd.Series(values)
    for mine, theirs in ((facts.skewness("v"), want.skew()), (facts.kurtosis("v"), want.kurt()), (facts.std(["v"])["v"], want.std())):
        assert (mine is None and math.isnan(theirs)) or mine == pytest.approx(theirs, rel=1e-9)


def test_constant_column_moments(spark):
    facts = Facts(series(spark, [0.1] * 10))
    assert facts.skewness("v") == 0.0 and facts.kurtosis("v") == 0.0 and facts.std(["v"]) == {"v": 0.0}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_pairwise_correlation_equals_pandas(spark, limit):
    data = pd.DataFrame(rng.normal(size=(500, 5)), columns=list("abcde"))
    data["b"] += data["a"] * 4
    data.loc[::3, "c"] = np.nan
    data.loc[::7, "d"] = np.nan
    data["flat"] = 0.1
    df = spark.createDataFrame([tuple(None if math.isnan(x) else x for x in map(float, r)) for r in data.to_numpy()], ", ".join(f"{c} double" for c in data))
    facts = Facts(df.repartition(4))
    columns = list(data.columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    means = {c: facts.scan()[c].mean for c in columns}
    sums = correlate.centred_sums(facts.df, pairs, means, {"c", "d"}, 500, expression_pairs=limit)
    want = data.corr()
    for a, b in pairs:
        r = correlate.pearson(sums[a, b])
        if "flat" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_levels_ties_sizes_and_bounds(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), ("c", None)], "x string, y string")
    got = levels(df, ["x", "y"], k=2)
    assert got["x"].top == (("a", 2), ("b", 2)) and (got["x"].n_unique, got["x"].n_rows) == (3, 5) and not got["x"].complete
    assert got["y"].n_unique == 0 and got["y"].complete


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("repeats", [(1,), (1, 1, 1, 2, 5), (2,), (3, 2, 1)])
def test_long_texts_rank_like_short_ones(spark, repeats, limit):
    words = [(f"{i * 37 % 101:03d}" + "long text " * 30,) for i in range(101) for _ in range(repeats[i % len(repeats)])] + [(None,)]
    df = spark.createDataFrame(words, "x string").repartition(5)
    assert long_text_levels(df, "x", 15, limit) == levels(df, ["x"], 15)["x"]
    assert Facts(df).levels(["x"])["x"] == levels(df, ["x"], 15)["x"]


def test_long_text_levels_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert long_text_levels(df, "x") == levels(df, ["x"])["x"]


def test_distinct_decisions_agree_at_any_size(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("unique"), (F.col("id") % 18_500).alias("below"), (F.col("id") % 19_000).alias("close"), (F.col("id") % 18_999).alias("under"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("half"), F.lit(None).cast("double").alias("nothing"),
    )
    want = {"unique": True, "below": False, "close": True, "under": False, "half": False, "nothing": False}
    assert distinct_share_reaches(df, df.columns, 20_000, 0.95, exact_rows=0) == want
    assert distinct_share_reaches(df, df.columns, 20_000, 0.95) == want


def test_profile_sections(spark):
    rows = [(i, i % 5, i % 2, None if i == 3 else "xy"[i % 2], TS(2024, 1, 1, 23) + datetime.timedelta(hours=i), 2000 + i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, v int, flag int, s string, t timestamp_ntz, birth_year int")
    p = profile(df)
    assert p["shape"] == {"rows": 20, "cols": 6} and p["missing"] == {"s": {"count": 1, "pct": 5.0}}
    assert list(p["numerical"]) == ["v"]  # id-like, indicator and *_year columns are hidden
    assert list(profile(df, hide_date_parts=False)["numerical"]) == ["v", "birth_year"]
    want = pd.Series([r[1] for r in rows])
    assert p["numerical"]["v"]["std"] == round(want.std(), 4) and p["numerical"]["v"]["75%"] == want.quantile(0.75)
    assert p["categorical"] == {"s": {"n_unique": 2, "top_5": {"x": 10, "y": 9}, "missing": 1}}
    assert p["temporal"]["t"] == {"min": "2024-01-01 23:00:00", "max": "2024-01-02 18:00:00", "range_days": 0, "missing": 0}


def test_profile_of_empty_and_all_null(spark):
    empty = profile(spark.createDataFrame([], "a int, s string, t timestamp_ntz"))
    assert empty["shape"]["rows"] == 0 and empty["numerical"] == {} and empty["temporal"]["t"]["range_days"] is None
    nulls = profile(spark.createDataFrame([(None, None)], "a int, s string"))
    assert nulls["missing"]["a"] == {"count": 1, "pct": 100.0} and nulls["categorical"]["s"]["n_unique"] == 0


def test_histogram_edges(spark):
    df = series(spark, [0.0, 1.0, 29.0, 30.0, None])
    assert {r["bin"]: r["n"] for r in charts.histogram(df, ["v"]).collect()} == {0: 1, 1: 1, 29: 2}
    flat = charts.histogram(series(spark, [5.0, 5.0]), ["v"]).collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(15, 2)]


def test_box_whiskers(spark):
    row = charts.box_statistics(series(spark, [1, 2, 3, 4, 5, 100]), ["v"]).first()
    assert (row["whisker_low"], row["whisker_high"], row["n_fliers"]) == (1.0, 5.0, 1)


def test_series_and_monthly(spark):
    rows = [(TS(2024, 1, 1) + datetime.timedelta(days=i), float(i)) for i in range(60)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    assert [r["v"] for r in charts.time_series(df.where("t is not null"), "t", ["v"]).collect()] == [float(i) for i in range(60)]
    bounded = charts.time_series(df, "t", ["v"], max_points=10).collect()
    assert len(bounded) == 10 and bounded[0]["t"] == TS(2024, 1, 1)
    months = charts.monthly_mean(df, "t", ["v"]).collect()
    assert [(r["month"], r["v"]) for r in months] == [(TS(2024, 1, 1), 15.0), (TS(2024, 2, 1), 45.0)]


def test_chart_set(spark):
    rows = [(i, float(i % 4), "ab"[i % 2], TS(2024, 1, 1 + i), None if i else 1) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, v double, s string, t timestamp_ntz, gap int")
    got = chart_data(df)
    assert set(got) == {"missing", "histogram", "box", "top", "series:t", "monthly:t", "correlation"}
    assert got["correlation"].count() == 3
    assert "monthly:t" not in chart_data(df.limit(10))
