import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from millrace import load
from millrace.functions.columns import POSITION
from millrace.sources import records as R


def state_after(line, inside, sep=",", quote='"'):
    """The state of a line read one character after the other."""
    start, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == quote:
                if line[i + 1 : i + 2] == quote:
                    i += 1
                else:
                    inside = False
        elif c == quote and start:
            inside, start = True, False
        else:
            start = c == sep
        i += 1
    return inside


def random_field(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice('a,"\n\r\n ') for _ in range(rng.randint(0, 8))).replace("\r", "")
    return rng.choice(["x", "5", "", "é", 'say "hi"', "two\nlines", ",", '"', "\n"])


def write_csv(path, rows, ends="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=ends, quoting=quoting).writerows(rows)
    path.write_bytes(out.getvalue().encode())


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_of_lines(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('a,"",x') for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    # text between a closing quote and the separator is no well-formed field
    lines = [x for x in {*lines, "", '"', '""', '"""', ',"', 'a"b', '5" nail,x', '"a,b",c', '","'}]
    out, inn = R.line_states(F.col("line"), ",", '"')
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", out.alias("o"), inn.alias("i")).collect()
    for r in got:
        assert (r.o, r.i) == (state_after(r.line, False), state_after(r.line, True)), r.line


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_records_across_splits(spark, tmp_path, small_splits, ends):
    rng = random.Random(len(ends))
    want = []
    for k in range(4):
        rows = [[str(i), *[random_field(rng) for _ in range(3)], f"{k}"] for i in range(60)]
        if k == 2:  # one record over many ranges
            rows[7][2] = "a long one\n" * 60
        want += [tuple(v or None for v in r) for r in rows]
        write_csv(tmp_path / f"{k}.csv", [["i", "a", "b\nb", "c", "k"], *rows], ends)
    df = load(spark, str(tmp_path), format="csv", keep_position=True)
    assert df.columns == ["i", "a", "b\nb", "c", "k", POSITION]
    got = df.orderBy(POSITION).collect()
    assert sorted((r["k"], r["i"], *r[1:4]) for r in got) == sorted((int(r[4]), int(r[0]), *r[1:4]) for r in want)
    # positions are in the order of each file
    for k in range(4):
        assert [r["i"] for r in got if r["k"] == k] == list(range(60))
    assert len({r[POSITION] for r in got}) == 240


def test_a_stray_inch_mark_costs_no_parallelism(spark, tmp_path, small_splits):
    body = "".join(f'{i},5" nail {i}\n' if i % 2 else f'{i},"quoted, {i}"\n' for i in range(200))
    (tmp_path / "n.csv").write_text("i,name\n" + body)
    df = load(spark, str(tmp_path / "n.csv"))
    assert df.rdd.getNumPartitions() > 10
    rows = {r["i"]: r["name"] for r in df.collect()}
    assert rows == {i: f'5" nail {i}' if i % 2 else f"quoted, {i}" for i in range(200)}


def test_breaks_are_read_in_several_tasks(spark, tmp_path, small_splits):
    write_csv(tmp_path / "b.csv", [["i", "t"], *[[i, f"first\nsecond, {i}" if i % 50 == 0 else f"plain {i}"] for i in range(300)]])
    assert R.survey(spark, str(tmp_path), ",", '"', "UTF-8") == "records"
    rows = R.records(spark, str(tmp_path / "b.csv"), ",", '"', "UTF-8")
    assert rows.where("NOT header").count() == 300
    assert R._lines(spark, str(tmp_path / "b.csv"), "UTF-8").rdd.getNumPartitions() > 10
    # ranges without a break are neither moved nor joined to lines of others
    touched = R._ranges(R._lines(spark, str(tmp_path), "UTF-8").withColumns(dict(zip(("out", "inn"), R.line_states(F.col("line"), ",", '"')))).withColumn("blank", F.col("line") == ""))
    assert 0 < touched.where("touched").count() < touched.count() / 2
    assert {r["i"]: r["t"] for r in load(spark, str(tmp_path / "b.csv")).collect()}[150] == "first\nsecond, 150"


def test_other_dialects(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes("i;t\n1;'x\ny'\n2;'it''s'\n\n3;z\n".encode())
    df = load(spark, str(tmp_path / "a.csv"), sep=";", quote="'")
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, "it's"), (3, "z")]
    (tmp_path / "l.csv").write_bytes('i,t\n1,"caf\xe9\nx"\n2,\x80\n'.encode("latin-1"))
    assert sorted(map(tuple, load(spark, str(tmp_path / "l.csv"), encoding="cp1252").collect())) == [(1, "café\nx"), (2, "€")]
    assert sorted(map(tuple, load(spark, str(tmp_path / "l.csv")).collect()))[0] == (1, "café\nx")
    (tmp_path / "r.csv").write_bytes(b'i,t\r1,"x\ry"\r2,z\r')
    assert sorted(map(tuple, load(spark, str(tmp_path / "r.csv")).collect())) == [(1, "x\ny"), (2, "z")]
    (tmp_path / "long.csv").write_bytes(b'i,t\n1,"x\ny",3\n2,z\n')
    with pytest.raises(ValueError, match="1 row"):
        load(spark, str(tmp_path / "long.csv"))
    assert load(spark, str(tmp_path / "long.csv"), long_rows="truncate").count() == 2
    (tmp_path / "open.csv").write_bytes(b'i,t\n1,x\n2,"never closed\n3,y\n')
    assert load(spark, str(tmp_path / "open.csv")).count() == 2
