"""Records of delimited text whose quoted fields hold line breaks, read in splits.

A line maps the state it starts in (between fields or inside a quoted one) to the state
it ends in. Such maps form a small monoid: a line without quotes changes nothing, most
lines with quotes end outside whatever came before, few open a field that stays open.
So the state before every line follows from a prefix composition, first inside each
(file, block) range, then over the ranges of a file, of which there is one row each. A
quote in the middle of an unquoted field (``5" nail``) opens nothing.

Lines of ranges that no quoted break touches stay where they were read; the others are
put in order within their range, and only lines of records that really span lines are
gathered, one group per record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import free_name
from ..workspace import materialise

# Column names of a line; free_name is not needed, as they never meet a column of the file.
_AT = ["file", "block"]


def line_states(line: Column, sep: str, quote: str) -> tuple[Column, Column]:
    """Whether ``line`` ends inside a quoted field: if it starts outside, and if it starts inside one."""
    q, s = re.escape(quote), re.escape(sep)
    # two quotes in a row are either an empty field or a quote inside a field: neither changes the state
    bare = F.replace(line, F.lit(quote + quote), F.lit(""))

    def ends_inside(rest: Column) -> Column:
        closed = F.regexp_replace(rest, f"(^|{s}){q}[^{q}]*{q}", "$1x")
        return F.contains(rest, F.lit(quote)) & closed.rlike(f"(^|{s}){q}")

    closing = F.instr(bare, quote)
    after = F.concat(F.lit("x"), F.substring(bare, closing + 1, F.length(bare)))
    return ends_inside(bare), (closing == 0) | ends_inside(after)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, block, row and text of every line; carriage returns stay."""
    raw = spark.read.text(path, lineSep="\n")
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("line"),
    )


def survey(spark: SparkSession, path: str, sep: str, quote: str, encoding: str) -> str:
    """'lines' if no quoted field can hold a line break, else 'records', or 'whole' where lines do not end in \\n."""
    opens, _ = line_states(F.col("line"), sep, quote)
    lone = F.col("line").rlike("\r(?!\\z)")
    found = _lines(spark, path, encoding).where(opens | (F.contains("line", F.lit(quote)) & lone))
    if not found.take(1):
        return "lines"
    return "whole" if found.where(lone).take(1) else "records"


def _before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` (keys, order, out, inn: the state after each row, started outside and inside) with the
    state before each: ``set`` where the rows before it decide it, else the first state of the range, flipped if ``odd``."""
    upto = Window.partitionBy(*keys).orderBy(order)
    flips = rows.withColumn("flips", F.sum((F.col("out") & ~F.col("inn")).cast("int")).over(upto))
    decided = F.when(F.col("out") == F.col("inn"), F.struct(F.col("out").alias("state"), F.col("flips").alias("at")))
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    known = flips.withColumn("known", F.last(decided, ignorenulls=True).over(earlier))
    since = F.col("flips") - (F.col("out") & ~F.col("inn")).cast("int") - F.coalesce("known.at", F.lit(0))
    odd = since % 2 == 1
    return known.withColumns({"odd": odd, "set": F.col("known.state") != odd}).drop("flips", "known")


def _after(first: Column) -> Column:
    """The state after a row whose range starts in ``first``."""
    before = F.coalesce("set", first != F.col("odd"))
    return F.when(before, F.col("inn")).otherwise(F.col("out"))


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per (file, block): whether it starts inside a field, whether any line opens one, whether it holds the first line."""
    ordered = _before(lines.select(*_AT, "row", "out", "inn", "blank"), _AT, "row")
    ends = ordered.groupBy(*_AT).agg(
        F.max_by(_after(F.lit(False)), "row").alias("out"),
        F.max_by(_after(F.lit(True)), "row").alias("inn"),
        F.bool_or("out").alias("opened"),
        F.bool_or(~F.col("blank")).alias("filled"),
    )
    carried = _before(ends, ["file"], "block").withColumn("inside", F.coalesce("set", "odd"))
    top = F.min(F.when(F.col("filled"), F.col("block"))).over(Window.partitionBy("file"))
    return carried.select(*_AT, "inside", (F.col("inside") | F.col("opened")).alias("touched"), (F.col("block") == top).alias("top"))


def records(spark: SparkSession, path: str, sep: str, quote: str, encoding: str) -> DataFrame:
    """file, block, row (of its first line) and text of every record that is not blank; ``header`` marks the first of each file."""
    out, inn = line_states(F.col("line"), sep, quote)
    lines = _lines(spark, path, encoding).withColumns({"out": out, "inn": inn, "blank": F.btrim("line", F.lit(" \t\r\f\x0b")) == ""})
    ranges = materialise(_ranges(lines), "ranges")
    placed = lines.join(ranges, _AT)
    quiet = placed.where(~F.col("touched") & ~F.col("top")).select(*_AT, "row", "line", "blank", F.lit(False).alias("header"))

    own = _before(placed.where(F.col("touched") | F.col("top")), _AT, "row")
    own = own.withColumn("before", F.coalesce("set", F.col("inside") != F.col("odd")))
    own = own.withColumn("after", F.when(F.col("before"), F.col("inn")).otherwise(F.col("out")))
    header = F.min(F.when(~F.col("blank") & F.col("top"), F.col("row"))).over(Window.partitionBy(*_AT))
    # a record is named by its first line; one that began in an earlier range is found below
    begun = F.last(F.when(~F.col("before"), F.col("row")), ignorenulls=True).over(Window.partitionBy(*_AT).orderBy("row"))
    own = materialise(
        own.withColumns({"header": header, "begun": begun}).select(*_AT, "row", "line", "blank", "before", "after", "header", "begun"), "lines"
    )
    first = F.col("row").eqNullSafe(F.col("header"))
    single = own.where(~F.col("before") & ~F.col("after")).withColumn("header", first).select(*quiet.columns)

    parts = own.where(F.col("before") | F.col("after"))
    opened = parts.groupBy(*_AT).agg(F.max_by(F.struct("block", "begun", "header"), "row").alias("last"))
    opened = opened.withColumn("last", F.when(F.col("last.begun").isNotNull(), F.col("last")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select(*_AT, F.last("last", ignorenulls=True).over(earlier).alias("origin"))
    named = parts.join(opened, _AT).select(
        "file",
        F.when(F.col("begun").isNull(), F.col("origin")).otherwise(F.struct("block", "begun", "header")).alias("record"),
        F.struct("block", "row", "line").alias("part"),
    )
    joined = named.groupBy("file", "record").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    spanning = joined.select(
        "file",
        F.col("record.block").alias("block"),
        F.col("record.begun").alias("row"),
        F.array_join("parts.line", "\n").alias("line"),
        F.lit(False).alias("blank"),
        F.col("record.begun").eqNullSafe(F.col("record.header")).alias("header"),
    )
    rows = quiet.unionByName(single).unionByName(spanning).where(~F.col("blank"))
    ends = F.regexp_replace("line", "\r\\z", "")
    return rows.select(*_AT, "row", "header", ends.alias("record"))


def parsed(rows: DataFrame, names: list[str], odd: str, position: str | None, options: dict) -> DataFrame:
    """Fields of the ``record`` of each row under ``names`` as text, and the record itself in ``odd`` where their number differs."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, odd])
    given = {k: str(v) for k, v in {**options, "columnNameOfCorruptRecord": odd, "mode": "PERMISSIVE"}.items() if k not in ("header", "encoding")}
    held = free_name("record", [*names, odd])
    read = rows.select(F.from_csv("record", schema, given).alias(held), *([F.struct(*_AT, "row").alias(position)] if position else []))
    return read.select(f"{held}.*", *([position] if position else []))
