import csv
import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import Settings, load, prepare, prepare_and_save


@pytest.fixture(scope="module")
def people(tmp_path_factory):
    """60 rows with an identifier, dates as text, gaps, one far salary and a column tied to another."""
    rng = np.random.default_rng(21)
    start = datetime.date(2022, 3, 1)
    rows = []
    for i in range(60):
        age = int(rng.integers(20, 60))
        rows.append({
            "id": i + 1,
            "day": (start + datetime.timedelta(days=int(rng.integers(0, 500)))).isoformat() if i % 12 else "",
            "age": age if i % 20 else "",
            "salary": 900_000 if i == 31 else 1000 * age + int(rng.integers(0, 900)),
            "town": "NORTH SOUTH EAST".split()[i % 3],
            "sex": ["f", "m"][int(rng.integers(0, 2))] if i % 15 else "NA",
            "score": round(float(rng.normal(50, 9)), 2),
        })
    path = tmp_path_factory.mktemp("people") / "people.csv"
    with open(path, "w", newline="") as f:
        writer = csv.DictWriter(f, rows[0])
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def expected(people):
    """The same steps on one machine, written out for this table only."""
    df = pd.read_csv(people)
    day = pd.to_datetime(df["day"]).ffill()
    fill = {"age": df["age"].median(), "sex": df["sex"].mode().iloc[0]}
    df = df.fillna(fill)
    for c in ("id", "age", "salary", "score"):
        q1, q3 = df[c].quantile([0.25, 0.75])
        df[c] = df[c].clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    out = df[["age", "salary", "sex", "score"]].copy()
    out["sex"] = (df["sex"] == "m").astype(int)
    for town in ("NORTH", "SOUTH"):
        out[f"town_{town}"] = (df["town"] == town).astype(int)
    for part in ("year", "month", "day", "dayofweek", "quarter"):
        out[f"day_{part}"] = getattr(day.dt, part)
    out["day_is_weekend"] = day.dt.dayofweek.isin([5, 6]).astype(int)
    unique = out.nunique() / len(out)
    out = out.drop(columns=[c for c in out if unique[c] >= 0.95])
    out = out.drop(columns=[c for c in out if out[c].std() < 0.01])
    corr = out.corr().abs()
    return out.drop(columns=[c for j, c in enumerate(out) if (corr.iloc[:j, j] > 0.95).any()])


def test_whole_run_equals_pandas(spark, people, expected):
    result = prepare(people, spark)
    got = result.df.toPandas()
    assert list(got.columns) == list(expected.columns)
    key = list(expected.columns)
    a = got.astype(float).sort_values(key).to_numpy()
    b = expected.astype(float).sort_values(key).to_numpy()
    np.testing.assert_allclose(a, b)
    report = result.report
    assert list(report) == [
        "raw_profile", "cleaned_profile", "cleaning", "encoding", "feature_engineering", "processed_profile", "charts", "shapes",
    ]
    assert report["cleaning"]["missing_values_filled"] == {"day": 5, "age": 3, "sex": 4}
    assert report["raw_profile"]["dtypes"]["day"] == "string" and report["cleaned_profile"]["dtypes"]["day"] == "timestamp_ntz"
    assert report["feature_engineering"]["identifier_columns_dropped"][0] == "id"
    assert report["shapes"]["engineered"] == {"rows": 60, "cols": len(key)}
    assert all(df.count() > 0 for df in result.charts.values()) and set(result.charts) == set(report["charts"])
    assert result.mappings.where("column = 'town'").count() == 3
    json.dumps(report, default=str)


def test_run_from_a_frame_needs_an_order_for_date_gaps(spark, people):
    raw = load(spark, people)
    with pytest.raises(ValueError, match="order_by"):
        prepare(raw, visualize=False)
    by_id = prepare(raw, visualize=False, order_by=["id"])
    by_file = prepare(people, spark, visualize=False)
    assert by_id.df.exceptAll(by_file.df).count() == 0 == by_file.df.exceptAll(by_id.df).count()


def test_all_settings_are_reachable(spark, people):
    result = prepare(
        people, spark, settings=Settings(outlier_method="zscore", outlier_action="remove"), missing_strategy="drop", visualize=False,
        encoding_strategy="label", extract_date_features=False, drop_identifiers=False, drop_low_variance=False, drop_high_correlation=False,
    )
    assert result.charts == {} and list(result.report["feature_engineering"]) == []
    assert "salary" in result.report["cleaning"]["outliers_handled"]
    assert set(result.df.columns) == {"id", "day", "age", "salary", "town", "sex", "score"}
    with pytest.raises(TypeError):
        prepare(people, spark, no_such_setting=1)
    constant = prepare(load(spark, people).select("id", "age"), missing_strategy="constant", missing_fill_value=-1, outlier_method="none", visualize=False)
    assert constant.report["cleaning"] == {
        "duplicates_removed": 0, "columns_dropped_high_missing": [], "missing_values_filled": {"age": 3},
    }


def test_run_and_save(spark, people, tmp_path):
    table, report = str(tmp_path / "new" / "out.csv"), str(tmp_path / "other" / "report.json")
    result = prepare_and_save(people, table, report, spark=spark, visualize=False)
    saved = load(spark, table)
    assert saved.columns == result.df.columns and saved.count() == 60
    text = "\n".join(r["value"] for r in spark.read.text(report).collect())
    assert json.loads(text)["processed_profile"]["shape"]["rows"] == 60
    prepare_and_save(people, table, report, spark=spark, visualize=False)  # overwrites its own output


def test_every_output_column_is_numeric(spark, table):
    for name in ("customer", "part", "events"):
        out = prepare(table(name), visualize=False).df
        assert out.columns and all(t in ("int", "bigint", "double") for _, t in out.dtypes)


def test_result_does_not_depend_on_partitions(spark, table):
    orders = table("orders")
    one, two = prepare(orders.coalesce(1), visualize=False), prepare(orders.repartition(13), visualize=False)
    drop = lambda r: {k: v for k, v in r.report.items() if k != "charts"}
    assert drop(one) == drop(two)
    assert one.df.exceptAll(two.df).count() == 0


def test_text_table_with_duplicates_and_file_order(spark, tmp_path):
    path = tmp_path / "d.csv"
    lines = ["t,v"] + [f"2024-01-{1 + i % 28:02d},{i % 28}" for i in range(56)] + [",1000", ",2000"]
    path.write_text("\n".join(lines) + "\n")
    result = prepare(str(path), spark, visualize=False, outlier_method="none", drop_identifiers=False, drop_high_correlation=False)
    assert result.report["cleaning"]["duplicates_removed"] == 28
    late = result.df.where(F.col("v") >= 1000).collect()
    assert [r["t_day"] for r in late] == [28, 28]  # the last date before them in the file


def test_scratch_tables_can_be_released(spark, tmp_path):
    import os

    path = tmp_path / "r.csv"
    path.write_text("a,b\n" + "".join(f"{i},{i % 7}\n" for i in range(50)))
    result = prepare(str(path), spark=spark, visualize=False)
    assert result.scratch and all(os.path.isdir(p.removeprefix("file:")) for p in result.scratch)
    assert result.df.count() == 50
    result.release()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in result.scratch)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from millrace import workspace

    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.scratch_root(Session())
