import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import Facts, clean, prepare, profile
from millrace.operators import missing, outliers
from millrace.operators.dedupe import drop_duplicates_counted
from millrace.operators.infer import infer_types
from millrace.operators.missing import fill_missing
from millrace.operators import ordered
from millrace.operators.ordered import ordered_fill

TS = datetime.datetime


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, column, by="k"):
    return [r[column] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("copies", [0, 1, 300])
def test_dedupe_counts_and_equality(spark, copies):
    rows = [(i, None if i % 3 else float(i), "t") for i in range(200)] + [(7, None, "t")] * copies
    df = frame(spark, rows, "k int, v double, s string")
    unique, before, removed = drop_duplicates_counted(df)
    assert (before, removed) == (200 + copies, copies)
    assert unique.count() == 200 and unique.columns == df.columns
    assert unique is df if not copies else unique is not df


def test_dedupe_null_and_zero_equality(spark):
    df = spark.sql("select * from values (0.0D, null), (-0.0D, null), (null, 1), (1D, null) t(a, b)")
    assert drop_duplicates_counted(df)[2] == 1


NUMBERS = {"12": 12.0, " 3.5 ": 3.5, "+.5": 0.5, "1e3": 1000.0, "-7.": -7.0, "inf": math.inf, "-Infinity": -math.inf}
NOT_NUMBERS = ["1,000", "1_000", "0x10", "True", "-", "1d", "2f", "nan", "", "1 2"]


def test_number_texts(spark):
    from millrace.functions.parsing import to_number

    df = frame(spark, [(t,) for t in [*NUMBERS, *NOT_NUMBERS]], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", to_number(F.col("t")).alias("v")).collect()}
    assert got == {**NUMBERS, **{t: None for t in NOT_NUMBERS}}


DATES = {
    "2023-01-05": TS(2023, 1, 5), "2023-1-5 10:30": TS(2023, 1, 5, 10, 30), "2023-01-05T10:30:15.25": TS(2023, 1, 5, 10, 30, 15, 250000),
    "01/02/2023": TS(2023, 1, 2), "13/02/2023": TS(2023, 2, 13), "2/13/2023 08:05": TS(2023, 2, 13, 8, 5),
    "2023/3/4": TS(2023, 3, 4), "20230405": TS(2023, 4, 5), "Jan 5 2023": TS(2023, 1, 5), "January 5, 2023": TS(2023, 1, 5),
    "5 May 2023": TS(2023, 5, 5), "05-Sep-2023": TS(2023, 9, 5), "1/2/2023 3:04 pm": TS(2023, 1, 2, 15, 4),
    "2023-01-05T10:00:00+02:00": TS(2023, 1, 5, 8), "2023-01-05 10:00:00Z": TS(2023, 1, 5, 10),
    "10:30": None, "Market 5 2023": None, "2023-13-40": None, "31/31/2023": None, "hello": None, "12": None,
}


SHORT_DATES = {
    "01/05/23": TS(2023, 1, 5), "1-2-23": TS(2023, 1, 2), "13.2.23 10:15": TS(2023, 2, 13, 10, 15), "5 Jan 23": TS(2023, 1, 5),
    "2023-01-05 03:04 PM": TS(2023, 1, 5, 15, 4), "Jan 2023": TS(2023, 1, 1), "January 2023": TS(2023, 1, 1),
    "Thu Jan 5 2023": TS(2023, 1, 5), "Thursday, January 5, 2023": TS(2023, 1, 5), "Sept 5 2023": TS(2023, 9, 5),
    "20230105T101500": TS(2023, 1, 5, 10, 15), "Thu, 05 Jan 2023 10:15:00 +0200": TS(2023, 1, 5, 8, 15),
    "Thu, 05 Jan 2023 10:15:00 GMT": TS(2023, 1, 5, 10, 15), "1/2/69": TS(1969, 1, 2), "1/2/68": TS(2068, 1, 2),
    "Monday": None, "Sat 5": None, "1/2/3": None, "x" * 100: None,
}


def test_short_and_spoken_date_texts(spark):
    from millrace.functions.parsing import to_timestamp

    df = frame(spark, [(t,) for t in SHORT_DATES], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", to_timestamp(F.col("t")).alias("v")).collect()} == SHORT_DATES


def test_order_is_asked_for_before_the_work(spark):
    df = frame(spark, [(1, None), (2, TS(2024, 1, 1)), (3, TS(2024, 1, 2))], "a int, t timestamp_ntz")
    with pytest.raises(ValueError, match=r"\['t'\].*order_by"):
        prepare(df)


def test_ordered_fill_is_stored(spark):
    df = frame(spark, [(i, None if i % 3 else float(i)) for i in range(30)], "k int, v double")
    out = fill_missing(df, "ffill", order_by=["k"])[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert {r["k"]: r["v"] for r in out.collect()} == {i: float(i - i % 3) for i in range(30)}


def test_date_texts(spark):
    from millrace.functions.parsing import to_timestamp

    df = frame(spark, [(t,) for t in DATES], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", to_timestamp(F.col("t")).alias("v")).collect()} == DATES


def test_infer_needs_more_than_80_percent_of_all_rows(spark):
    at = frame(spark, [(str(i) if i < 8 else None,) for i in range(10)], "a string")
    above = frame(spark, [(str(i) if i < 9 else "x",) for i in range(10)], "a string")
    assert infer_types(at)[1] == {}
    out, made = infer_types(above)
    assert made == {"a": "bigint"} and out.where("a is null").count() == 1
    assert infer_types(frame(spark, [("1",), ("2.5",)], "a string"))[1] == {"a": "double"}
    assert infer_types(frame(spark, [], "a string"))[1] == {}


def test_infer_from_known_values_equals_the_scan(spark):
    df = frame(spark, [("1", "2024-01-01", "u"), ("2", "2024-01-02", None), ("1", "x", "w")] * 5, "a string, b string, c string")
    facts = Facts(df)
    facts.levels(df.columns)
    for share in (0.5, 0.8):
        assert infer_types(df, share, facts=facts)[1] == infer_types(df, share)[1]


def test_high_missing_is_strict(spark):
    df = frame(spark, [(1, None), (1, 2)], "a int, b int")
    assert missing.high_missing_columns(Facts(df), 0.5) == []
    assert missing.high_missing_columns(Facts(df), 0.49) == ["b"]


def test_fill_strategies_by_role(spark):
    rows = [
        (1, 1, "b", TS(2024, 1, 1), True), (2, None, None, None, None), (3, 4, "a", TS(2024, 1, 3), True),
        (4, 10, "a", None, False), (5, 5, "b", None, None),
    ]
    df = frame(spark, rows, "k int, n int, s string, t timestamp_ntz, f boolean")
    out, report, _ = missing.fill_missing(df, "auto", order_by=["k"])
    assert report == {"n": 1, "s": 1, "t": 3, "f": 2}
    assert values(out, "n") == [1.0, 4.5, 4.0, 10.0, 5.0]
    assert values(out, "s") == ["b", "a", "a", "a", "b"]  # a and b tie: the smaller wins
    assert values(out, "t") == [TS(2024, 1, 1)] * 2 + [TS(2024, 1, 3)] * 3
    assert values(out, "f") == [True, True, True, False, True]


def test_fill_mean_and_median_of_dates(spark):
    df = frame(spark, [(1, TS(2024, 1, 1)), (2, TS(2024, 1, 3)), (3, TS(2024, 1, 8)), (4, None)], "k int, t timestamp_ntz")
    assert values(missing.fill_mean(df, ["t"]), "t")[3] == TS(2024, 1, 4)
    assert values(missing.fill_median(df, ["t"]), "t")[3] == TS(2024, 1, 3)


def test_mode_compares_numbers_as_numbers(spark):
    df = frame(spark, [(i, v) for i, v in enumerate([10.0, 9.0, 10.0, 9.0, None])], "k int, v double")
    assert values(missing.fill_mode(df, ["v"]), "v")[4] == 9.0


def test_all_null_column_stays(spark):
    df = frame(spark, [(1, None, None), (2, None, None)], "k int, v double, s string")
    out = missing.fill_missing(df, "mode")[0]
    assert values(out, "v") == [None, None] and values(out, "s") == [None, None]
    assert values(missing.fill_median(df, ["v"]), "v") == [None, None]


def test_drop_report_is_sequential(spark):
    df = frame(spark, [(None, None), (None, 1), (1, None), (1, 1)], "a int, b int")
    out, report, facts = missing.fill_missing(df, "drop")
    assert report == {"a": 2, "b": 1} and out.count() == 1 and facts.rows == 1
    gone = frame(spark, [(None, None), (1, 1)], "a int, b int")
    assert missing.fill_missing(gone, "drop")[1] == {"a": 1}


def test_bad_fills_fail_before_any_job(spark):
    df = frame(spark, [("x",), (None,)], "s string")
    for bad in ({"strategy": "mean"}, {"strategy": "median"}, {"strategy": "constant"}, {"strategy": "guess"}):
        with pytest.raises(ValueError):
            missing.fill_missing(df, **bad)
    with pytest.raises(ValueError, match="order_by"):
        missing.fill_missing(df, "ffill")
    with pytest.raises(ValueError, match="does not fit"):
        missing.fill_missing(df, "constant", fill_value=3)
    assert missing.fill_missing(df, "constant", fill_value="y")[0].where("s = 'y'").count() == 1


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("rows_per_range", [7, 100, 10_000])
def test_ordered_fill_equals_pandas(spark, direction, rows_per_range):
    rng = np.random.default_rng(3)
    n = 1000
    keys = rng.permutation(n)
    v = np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n))
    w = np.where(rng.random(n) < 0.995, None, "w")
    pdf = pd.DataFrame({"k": keys, "v": v, "w": w})
    df = frame(spark, [(int(k), None if math.isnan(x) else float(x), y) for k, x, y in zip(keys, v, w)], "k int, v double, w string")
    out = ordered_fill(df.repartition(5), ["v", "w"], ["k"], direction, rows_per_range=rows_per_range)
    sorted_pdf = pdf.sort_values("k")
    want = sorted_pdf.ffill() if direction == "forward" else sorted_pdf.bfill()
    got = out.orderBy("k").toPandas()
    assert out.columns == df.columns and len(got) == n
    np.testing.assert_allclose(got["v"], want["v"].astype(float))
    assert got["w"].where(got["w"].notna(), None).tolist() == want["w"].where(want["w"].notna(), None).tolist()


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_ordered_fill_with_stored_ranges(spark, monkeypatch, direction):
    """More ranges than literals: dealt out by Spark, carried over groups of ranges."""
    monkeypatch.setattr(ordered, "LITERAL_CUTS", 8)
    monkeypatch.setattr(ordered, "GROUP", 4)
    rows = [(i * 37 % 600, None if i % 41 else i, None if i % 300 else "w") for i in range(600)]
    df = frame(spark, rows, "k int, v int, w string").repartition(5)
    got = ordered_fill(df, ["v", "w"], ["k"], direction, rows_per_range=15)
    want = ordered_fill(df, ["v", "w"], ["k"], direction, rows_per_range=10_000)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_stored_partitions_follow_rows_not_ranges(spark, monkeypatch, direction):
    """Spark sends keys per partition to the driver: few partitions hold many ranges, none of them too large."""
    monkeypatch.setattr(ordered, "LITERAL_CUTS", 8)
    monkeypatch.setattr(ordered, "GROUP", 4)
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 300, raising=False)
    stored = []

    def recorded(df, label):
        out = ordered_materialise(df, label)
        stored.append((df.rdd.getNumPartitions(), out))
        return out

    ordered_materialise = ordered.materialise
    monkeypatch.setattr(ordered, "materialise", recorded)
    # The runs without a value are longer than a partition; a third of the rows shares a key, twenty have none.
    rows = [(None if i < 20 else 500 if 500 <= i < 1000 else i, i, i if i % 700 == 30 else None) for i in range(1500)]
    df = frame(spark, rows, "k int, id int, v int").repartition(5)
    got = ordered_fill(df, ["v"], ["k"], direction, rows_per_range=7)
    (partitions, ranged), = stored
    assert partitions == 5
    key, rng = ranged.columns[-2:]
    edges = ranged.groupBy(rng).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(rng).collect()
    assert sum(e["n"] for e in edges) == 1500 and max(e["n"] for e in edges) == 7
    assert all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:]))
    want = ordered_fill(df, ["v"], ["k"], direction, rows_per_range=10_000)
    assert values(got, "v", "id") == values(want, "v", "id")
    if direction == "forward":
        near = {i: max((p for p in (30, 730, 1430) if p <= i), default=None) for i in range(1500)}
    else:
        near = {i: min((p for p in (30, 730, 1430) if p >= i), default=None) for i in range(1500)}
    assert all(r["v"] == near[r["id"]] for r in got.where("k >= 20 and k != 500").collect())


def test_ordered_fill_with_one_hot_key(spark):
    rows = [(0 if i < 400 else i, i, None if i % 4 else float(i)) for i in range(1000)]
    df = frame(spark, rows, "k int, id int, v double")
    one = ordered_fill(df, ["v"], ["k"], rows_per_range=50)
    two = ordered_fill(df.repartition(7), ["v"], ["k"], rows_per_range=1_000_000)
    assert values(one, "v", "id") == values(two, "v", "id")
    rest = [r for r in one.where("k >= 400").orderBy("k").collect()]
    assert all(r["v"] == r["id"] - r["id"] % 4 for r in rest)


def test_iqr_bounds_and_guards(spark):
    df = frame(spark, [(i, v, v if i < 3 else None) for i, v in enumerate([1, 2, 3, 4, 100])], "k int, v int, few int")
    out, report, facts = outliers.handle_outliers(df, columns=["v", "few"])
    assert report == {"v": 1}
    assert values(out, "v") == [1.0, 2.0, 3.0, 4.0, 7.0]
    assert dict(out.dtypes)["few"] == "int"  # under four values: untouched
    assert facts.scan()["v"].hi == 7.0
    assert outliers.handle_outliers(df, "none")[1] is None and outliers.handle_outliers(df, "iqr", "none")[1] is None
    with pytest.raises(ValueError):
        outliers.handle_outliers(df, "mad")


def test_clip_keeps_nulls_and_exclude(spark):
    df = frame(spark, [(i, v) for i, v in enumerate([1.0, 2.0, 2.5, 3.0, None, -900.0])], "k int, v double")
    out, report, _ = outliers.handle_outliers(df, columns=["v"])
    assert report == {"v": 1} and values(out, "v")[4] is None and values(out, "v")[5] > -10
    assert outliers.handle_outliers(df, columns=["v"], exclude=["v"])[1] == {}


def test_zscore_bounds_are_data_values_and_constant_is_safe(spark):
    data = [0.0] * 30 + [1.0] * 30 + [500.0]
    df = frame(spark, [(i, v, 0.1) for i, v in enumerate(data)], "k int, v double, flat double")
    facts = Facts(df)
    assert outliers.outlier_bounds(facts, ["v", "flat"], "zscore") == {"v": (0.0, 1.0)}
    assert outliers.handle_outliers(df, "zscore", columns=["v", "flat"])[1] == {"v": 1}


def test_remove_is_sequential_and_keeps_null_rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.standard_t(2, 400), "b": rng.standard_t(2, 400), "c": rng.random(400)})
    pdf["b"] += pdf["a"] * 3
    pdf.loc[::9, "b"] = np.nan
    want = pdf.copy()
    report = {}
    for c in want.columns:
        q1, q3 = want[c].quantile([0.25, 0.75])
        out = (want[c] < q1 - 1.5 * (q3 - q1)) | (want[c] > q3 + 1.5 * (q3 - q1))
        if out.sum():
            report[c] = int(out.sum())
            want = want[~out]
    df = frame(spark, [tuple(None if math.isnan(x) else float(x) for x in r) for r in pdf.to_numpy()], "a double, b double, c double")
    got, counts, facts = outliers.handle_outliers(df, "iqr", "remove")
    assert counts == report and got.count() == len(want) == facts.rows


def test_clean_report_and_order(spark):
    rows = [("1", "a", None, 1.0), ("1", "a", None, 1.0), ("2", None, None, 2.0), ("3", "b", 1, None), ("4", "a", None, 500.0), ("5", "a", None, 1.5)]
    stage = clean(frame(spark, rows, "n string, s string, sparse int, v double"))
    assert stage.report == {
        "duplicates_removed": 1, "columns_dropped_high_missing": ["sparse"],
        "missing_values_filled": {"s": 1, "v": 1}, "outliers_handled": {"v": 1},
    }
    assert stage.df.dtypes == [("n", "bigint"), ("s", "string"), ("v", "double")]
    assert stage.facts.rows == 5
    assert "outliers_handled" not in clean(frame(spark, rows, "n string, s string, sparse int, v double"), outlier_method="none").report


def test_nan_and_decimals_in_a_plain_frame(spark):
    nan = float("nan")
    df = frame(spark, [(1.0, 1), (nan, 2), (nan, 2), (3.0, 3), (5.0, 4)], "v double, k int")
    df = df.withColumn("d", F.col("k").cast("decimal(10,2)"))
    stage = clean(df)
    assert stage.report["duplicates_removed"] == 1 and stage.report["missing_values_filled"] == {"v": 1}
    assert values(stage.df, "v") == [1.0, 3.0, 3.0, 5.0] and dict(stage.df.dtypes)["d"] == "double"
    assert profile(df)["missing"] == {"v": {"count": 2, "pct": 40.0}}


def test_clean_empty_frame(spark):
    stage = clean(frame(spark, [], "a int, s string, t timestamp_ntz"))
    assert stage.df.count() == 0 and stage.report["duplicates_removed"] == 0
