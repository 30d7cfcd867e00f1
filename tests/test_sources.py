import json

import pytest
from pyspark.sql import functions as F

from millrace import load, prepare_and_save, preview, save_report, save_table
from millrace.functions.columns import POSITION
from millrace.sources.readers import header_names


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_missing_path_comes_before_format(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "nothing.csv"))
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "nothing.txt"))


def test_unknown_extension_lists_the_supported_ones(spark, tmp_path):
    with pytest.raises(ValueError, match="parquet"):
        load(spark, write(tmp_path / "test.txt", "plain"))
    with pytest.raises(ValueError, match="unsupported format"):
        load(spark, write(tmp_path / "a.csv", "a\n1\n"), format="excel")


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = write(
        tmp_path / "T.CSV",
        'i,f,b,s,empty,mixed\n1,1.5,True,x,,1\n-2,NA,false,n/a,NaN,y\n3,2e3,,"a,b",,\n',
    )
    df = load(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "empty": "double", "mixed": "string",
    }
    assert [tuple(r) for r in df.orderBy("i").collect()] == [
        (-2, None, False, None, None, "y"), (1, 1.5, True, "x", None, "1"), (3, 2000.0, None, "a,b", None, None),
    ]


def test_integers_beyond_64_bits_become_double(spark, tmp_path):
    df = load(spark, write(tmp_path / "big.csv", "a\n1\n99999999999999999999\n"))
    assert df.dtypes == [("a", "double")]


def test_short_rows_are_padded_and_long_rows_rejected(spark, tmp_path):
    short = load(spark, write(tmp_path / "short.csv", "a,b\n1,2\n3\n"))
    assert sorted((r["a"], r["b"]) for r in short.fillna(-1).collect()) == [(1, 2), (3, -1)]
    path = write(tmp_path / "long.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="more fields"):
        load(spark, path)
    assert load(spark, path, long_rows="truncate").count() == 2


def test_surplus_fields_are_found_when_empty_or_quoted(spark, tmp_path):
    for i, row in enumerate(['3,4,,5', '3,4,', '3,"4,4",5', '"3","4",']):
        path = write(tmp_path / f"s{i}.csv", f"a,b\n1,2\n{row}\n")
        with pytest.raises(ValueError, match="1 row"):
            load(spark, path)
    fine = write(tmp_path / "fine.csv", 'a,b\n1,"2,3,4"\n3\n"x ""y"", z",5\n')
    assert sorted((r["a"], r["b"]) for r in load(spark, fine).fillna("-").collect()) == [("1", "2,3,4"), ("3", "-"), ('x "y", z', "5")]


def test_quoted_line_breaks(spark, tmp_path):
    text = 'a,b,c\n1,"x\ny",5\n2,"p\n\n""q"", r",6\n3,z,"w\n"\n'
    df = load(spark, write(tmp_path / "b.csv", text))
    assert df.dtypes[0] == ("a", "bigint")
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny", "5"), (2, 'p\n\n"q", r', "6"), (3, "z", "w\n")]
    tall = "a,b\n" + "".join(f'{i},"line\n{i}"\n' for i in range(500))
    assert load(spark, write(tmp_path / "t.csv", tall), keep_position=True).count() == 500


def test_outputs_apart_from_inputs(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    spark.range(5).write.parquet(source)
    df = load(spark, source)
    for out in (source, f"{source}/part", str(tmp_path), "file://" + source):
        if not out.endswith("/part"):  # beside the files of the source nothing is overwritten
            with pytest.raises(ValueError, match="overwrite the input"):
                save_table(df, out, format="parquet")
        with pytest.raises(ValueError, match="overwrite the input"):
            prepare_and_save(source, out, str(tmp_path / "report.json"), spark=spark)
    with pytest.raises(ValueError, match="overwrite the input"):
        prepare_and_save(df, str(tmp_path.parent / "elsewhere.csv"), source)
    assert spark.read.parquet(source).count() == 5
    save_table(df, source + "2", format="parquet")
    assert spark.read.parquet(source + "2").count() == 5


def test_json_fields_in_order_of_first_sight(spark, tmp_path):
    records = [{"z": 1, "b": 2}, {"z": 3, "y": 4, "b": 5}, {"a": 6}]
    lines = write(tmp_path / "l.json", "\n".join(map(json.dumps, records)))
    array = write(tmp_path / "a.json", json.dumps(records))
    tall = write(tmp_path / "t.json", json.dumps([{f"k{i}": i for i in range(600, 0, -1)}], indent=1))
    for path in (lines, array):
        assert load(spark, path).columns == ["z", "b", "y", "a"]
    assert load(spark, tall).columns == [f"k{i}" for i in range(600, 0, -1)]


def test_zoned_times_become_the_clock_of_the_session(spark, tmp_path):
    path = str(tmp_path / "z.parquet")
    spark.sql("select timestamp'2024-01-05 05:00:00 UTC' as t").write.parquet(path)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = load(spark, path)
        assert df.dtypes == [("t", "timestamp_ntz")] and str(df.first()["t"]) == "2024-01-05 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_tsv_and_reader_options(spark, tmp_path):
    assert load(spark, write(tmp_path / "a.tsv", "a\tb\n1\tx,y\n")).collect()[0]["b"] == "x,y"
    assert load(spark, write(tmp_path / "a.csv", "a|b\n1|2\n"), sep="|").collect()[0]["b"] == 2


def test_header_names():
    assert header_names(["a", "a", "b", "a", None, "A"]) == ["a", "a.1", "b", "a.2", "Unnamed: 4", "A_1"]


def test_odd_column_names(spark, tmp_path):
    df = load(spark, write(tmp_path / "n.csv", "a.b,c d,a.b\n1,2,3\n"))
    assert df.columns == ["a.b", "c d", "a.b.1"]
    assert tuple(df.first()) == (1, 2, 3)


def test_latin1_fallback_and_valid_utf8(spark, tmp_path):
    text = "name,n\ncafé,1\n"
    assert load(spark, write(tmp_path / "l.csv", text, "latin-1")).first()["name"] == "café"
    assert load(spark, write(tmp_path / "u.csv", text)).first()["name"] == "café"
    assert load(spark, write(tmp_path / "h.csv", "né,n\n1,2\n", "latin-1")).columns == ["né", "n"]
    # A replacement character that really is in the file stays.
    assert load(spark, write(tmp_path / "r.csv", "name\n�\n")).first()["name"] == "�"


def test_named_encodings(spark, tmp_path):
    path = write(tmp_path / "w.csv", "preis €,n\n“10 €”,1\n", "cp1252")
    df = load(spark, path, encoding="windows-1252")
    assert df.columns == ["preis €", "n"] and df.first()[0] == "“10 €”"
    assert load(spark, write(tmp_path / "l.csv", "é\nü\n", "latin-1"), encoding="latin-1").first()["é"] == "ü"
    for bad in ("no-such-code", "cp037"):
        with pytest.raises(ValueError, match="encoding"):
            load(spark, path, encoding=bad)


def test_json_forms_keep_field_order(spark, tmp_path):
    records = [{"z": 1, "a": "x", "n": {"k": [1, 2]}}, {"z": 2, "a": None, "n": None}]
    array = write(tmp_path / "a.json", json.dumps(records))
    lines = write(tmp_path / "l.json", "\n".join(json.dumps(r) for r in records))
    pretty = write(tmp_path / "p.json", json.dumps(records, indent=2))
    for path in (array, lines, pretty):
        df = load(spark, path)
        assert df.columns == ["z", "a", "n"]
        assert df.orderBy("z").first()["n"] == '{"k":[1,2]}'
    assert load(spark, pretty).count() == 2
    assert dict(load(spark, array, stringify_nested=False).dtypes)["n"].startswith("struct")


def test_parquet_normalisation(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.sql(
        "select cast('NaN' as double) as f, cast(1.5 as decimal(10,2)) as d, date'2024-02-03' as t, array(1,2) as a, true as b"
    ).write.parquet(path)
    df = load(spark, path)
    assert dict(df.dtypes) == {"f": "double", "d": "double", "t": "timestamp_ntz", "a": "string", "b": "boolean"}
    row = df.first()
    assert row["f"] is None and row["d"] == 1.5 and row["a"] == "[1,2]"


@pytest.mark.parametrize("suffix", [".csv", ".parquet"])
def test_row_position_orders_rows_like_the_file(spark, tmp_path, suffix):
    path = str(tmp_path / f"pos{suffix}")
    save_table(spark.range(100).select(F.col("id").alias("n")).coalesce(1), path)
    df = load(spark, path, keep_position=True)
    assert POSITION in df.columns
    assert [r["n"] for r in df.orderBy(POSITION).collect()] == list(range(100))
    assert preview(df).columns == ["n"] and preview(df).count() == 20


def test_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "deep" / "r.json")
    save_report(spark, {"a": {"b": 1}, "t": object}, path)
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert json.loads(text)["a"] == {"b": 1}


def test_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok')], "a int, b string")
    for suffix in (".csv", ".tsv", ".json", ".parquet"):
        path = str(tmp_path / f"t{suffix}")
        save_table(df, path)
        assert tuple(load(spark, path).first()) == (1, 'say "hi", ok')
    with pytest.raises(ValueError):
        save_table(df, str(tmp_path / "x"), format="orc")
