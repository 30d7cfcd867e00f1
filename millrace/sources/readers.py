"""File scans: CSV, TSV, JSON and Parquet, by extension or explicit format."""

from __future__ import annotations

import codecs
import posixpath
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import POSITION, data_columns, free_name, normalise, ref, replace_columns
from ..functions.parsing import null_tokens_to_null
from ..operators.infer import infer_scan_types
from ..workspace import materialise
from .records import parsed, records, survey

# File extension -> format.
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}
SEPARATORS = {"csv": ",", "tsv": "\t"}
FALLBACK_ENCODING = "ISO-8859-1"
# Python's name of an encoding -> the name Spark's readers take.
ENCODINGS = {
    "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1", "utf-8": "UTF-8",
    "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-32": "UTF-32",
}
# Reader options (lower case) under which quotes or line ends mean something else.
_QUOTE_RULES = {"chartoescapequoteescaping", "comment", "linesep", "unescapedquotehandling", "ignoreleadingwhitespace"}
# Holds the line of a delimited row whose number of fields differs from the header's.
_ODD_ROW = "__odd_row"
_REPLACEMENT = "�"


def load(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    encoding: str = "utf-8",
    keep_position: bool = False,
    stringify_nested: bool = True,
    long_rows: str = "error",
    lines: bool | None = None,
    **options,
) -> DataFrame:
    """Scan ``path`` into typed columns with one kind of missing value (null).

    ``keep_position`` adds the hidden row-position column that ordered fills use.
    ``long_rows``: 'error' or 'truncate' for delimited rows with surplus fields.
    ``lines``: JSON lines or one record array; None looks at the first character.
    Further keywords go to the Spark reader.
    """
    _require_path(spark, path)
    fmt = format or detect_format(path)
    if fmt not in set(EXTENSIONS.values()):
        raise ValueError(f"unsupported format {fmt!r}; supported: {sorted(set(EXTENSIONS.values()))}")
    if fmt in SEPARATORS:
        return _load_delimited(spark, path, {"sep": SEPARATORS[fmt], **options}, encoding, keep_position, long_rows)
    if fmt == "json":
        df = _read_json(spark, path, encoding, lines, options)
    else:
        df = spark.read.options(**options).parquet(path)
    if keep_position:
        df = _with_position(df, "_metadata.row_index" if fmt == "parquet" else None)
    return normalise(df, stringify_nested)


def detect_format(path: str) -> str:
    extension = posixpath.splitext(path.rstrip("/"))[1].lower()
    if extension not in EXTENSIONS:
        raise ValueError(
            f"unsupported file extension {extension!r}; supported: {sorted(EXTENSIONS)} "
            "(for a directory without one, pass format=...)"
        )
    return EXTENSIONS[extension]


def spark_encoding(name: str) -> str:
    """Spark's name for ``name``; Windows-1252 is read as Latin-1 and its own characters are put right after."""
    try:
        known = codecs.lookup(name).name
    except LookupError:
        raise ValueError(f"unknown encoding {name!r}") from None
    if known == "cp1252":
        return FALLBACK_ENCODING
    if known not in ENCODINGS:
        raise ValueError(f"unsupported encoding {name!r}; supported: {sorted([*ENCODINGS, 'cp1252'])}")
    return ENCODINGS[known]


def _windows_characters() -> dict[str, str]:
    """Latin-1 reading -> Windows-1252 reading, where the two differ."""
    out = {}
    for code in range(0x80, 0xA0):
        try:
            out[chr(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return out


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.select(*[ref(c) for c in data_columns(df)]).limit(n)


def _require_path(spark: SparkSession, path: str) -> None:
    try:
        spark.read.text(path)  # analysis checks the path on any Spark file system; nothing is read
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such file or directory: {path}") from None
        raise


def _with_position(df: DataFrame, row: str | None) -> DataFrame:
    """Position = (file, block, row in block); unique, and ordered like the rows of each file."""
    at = F.col(row) if row else F.monotonically_increasing_id()
    return df.select(
        *[ref(c) for c in df.columns],
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            at.cast("bigint").alias("row"),
        ).alias(POSITION),
    )


# -- delimited text -------------------------------------------------------------


def _load_delimited(spark, path, options, encoding, keep_position, long_rows) -> DataFrame:
    if long_rows not in ("error", "truncate"):
        raise ValueError(f"long_rows must be 'error' or 'truncate', not {long_rows!r}")

    def typed(enc: str) -> tuple[DataFrame, dict]:
        df = (_scan_records if way == "records" else _scan_text)(spark, path, options, enc, keep_position)
        text = [c for c in data_columns(df) if c != _ODD_ROW]
        undecoded = F.lit(False)
        for c in text:
            undecoded = undecoded | F.coalesce(F.contains(ref(c), F.lit(_REPLACEMENT)), F.lit(False))
        fields = _field_count(ref(_ODD_ROW), options["sep"], options.get("quote", '"'))
        checks = {"long": F.count_if(fields > len(text)), "undecoded": F.count_if(undecoded)}
        clean = replace_columns(df, {c: null_tokens_to_null(ref(c)) for c in text})
        checked = clean.drop(_ODD_ROW)
        out, got = infer_scan_types(clean, checks)
        return out.select(*[ref(c) for c in checked.columns]), {
            **got,
            "undecoded": got["undecoded"] or any(_REPLACEMENT in c for c in text),
        }

    way = "lines" if "multiLine" in options else _way_to_read(spark, path, options, encoding)
    if way == "whole":
        options = {**options, "multiLine": True}
    df, found = typed(encoding)
    if found["undecoded"] and spark_encoding(encoding) == "UTF-8" and _has_invalid_utf8(spark, path):
        df, found = typed(FALLBACK_ENCODING)
    if found["long"] and long_rows == "error":
        raise ValueError(f"{found['long']} row(s) of {path} have more fields than the header; pass long_rows='truncate' to cut them")
    return df


def _way_to_read(spark: SparkSession, path: str, options: dict, encoding: str) -> str:
    """'lines' where no quoted field can hold a line break, else 'records' of ordered lines, or 'whole' files.

    Whole files are parsed where the quotes follow rules of the caller's own, in
    encodings whose line ends are no single byte, and where lines end in \\r alone.
    """
    quote = options.get("quote", '"')
    if not quote:
        return "lines"
    name = spark_encoding(encoding)
    own_rules = {k.lower() for k in options} & _QUOTE_RULES or options.get("escape", quote) != quote
    if own_rules or len(quote) > 1 or name.startswith("UTF-16") or name.startswith("UTF-32"):
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote)))
        return "whole" if spark.read.text(path).where(quotes % 2 == 1).take(1) else "lines"
    return survey(spark, path, options["sep"], quote, name)


def _field_count(line: Column, sep: str, quote: str) -> Column:
    """Fields of a delimited line, empty ones included; separators inside quotes do not count."""
    bare = line
    if quote:
        q = re.escape(quote)
        bare = F.regexp_replace(line, f"{q}[^{q}]*{q}", "")
    return F.size(F.split(bare, re.escape(sep)))


def _reader(spark, options, encoding):
    defaults = {"escape": '"', "encoding": spark_encoding(encoding), "mode": "PERMISSIVE"}
    return spark.read.options(**{**defaults, **options})


def _scan_text(spark, path, options, encoding, keep_position) -> DataFrame:
    """All columns as text under the header's names, plus the line of rows with other numbers of fields."""
    names, windows = _header(spark, path, options, encoding)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _ODD_ROW]])
    reader = _reader(spark, {**options, "header": True, "columnNameOfCorruptRecord": _ODD_ROW}, encoding)
    df = reader.schema(schema).csv(path)
    df = _windows_text(df, windows, df.columns)
    return _with_position(df, None) if keep_position else df


def _header(spark, path, options, encoding) -> tuple[list[str], dict[str, str]]:
    """The column names, and the characters that differ from those of the encoding Spark reads in."""
    first = _reader(spark, {**options, "header": False}, encoding).csv(path).first()
    if first is None:
        raise ValueError(f"{path} is empty: no header row")
    return _names(first, encoding)


def _names(first: Sequence[str | None], encoding: str) -> tuple[list[str], dict[str, str]]:
    windows = _windows_characters() if codecs.lookup(encoding).name == "cp1252" else {}
    return header_names([n and n.translate(str.maketrans(windows)) for n in first]), windows


def _windows_text(df: DataFrame, windows: dict[str, str], columns: Sequence[str]) -> DataFrame:
    if not windows:
        return df
    return replace_columns(df, {c: F.translate(ref(c), "".join(windows), "".join(windows.values())) for c in columns})


def _scan_records(spark, path, options, encoding, keep_position) -> DataFrame:
    """The same from the records that ordered lines make up."""
    sep, quote = options["sep"], options.get("quote", '"')
    rows = materialise(records(spark, path, sep, quote, spark_encoding(encoding)), "records")
    given = {"escape": quote, "multiLine": True, **options}
    head = rows.where("header").orderBy("file").limit(1)
    width = head.select(_field_count(F.col("record"), sep, quote)).first()[0]
    first = parsed(head, [f"c{i}" for i in range(width)], _ODD_ROW, None, given).drop(_ODD_ROW).first()
    names, windows = _names(first, encoding)
    df = parsed(rows.where("NOT header"), names, _ODD_ROW, POSITION if keep_position else None, given)
    return _windows_text(df, windows, [*names, _ODD_ROW])


def header_names(raw: Sequence[str | None]) -> list[str]:
    """Repeated names get .1, .2 ...; empty ones a number; names equal but for case get _1."""
    seen: dict[str, int] = {}
    names: list[str] = []
    for i, name in enumerate(raw):
        name = name if name not in (None, "") else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        names.append(free_name(name, names))
    return names


def _has_invalid_utf8(spark: SparkSession, path: str) -> bool:
    raw = spark.read.text(path)
    return bool(raw.where(~F.is_valid_utf8("value")).take(1))


# -- JSON -----------------------------------------------------------------------


def _read_json(spark, path, encoding, lines, options) -> DataFrame:
    if lines is None:
        start = F.substring(F.ltrim("value"), 1, 1)
        first = spark.read.text(path).select(start.alias("c")).where("c <> ''").first()
        lines = first is None or first["c"] != "["
    df = spark.read.options(**{"encoding": spark_encoding(encoding), "multiLine": not lines, **options}).json(path)
    named = [c for c in _field_order(spark, path, encoding, lines) if c in df.columns]
    return df.select(*[ref(c) for c in [*named, *(c for c in df.columns if c not in named)]])


def _field_order(spark: SparkSession, path: str, encoding: str, lines: bool) -> list[str]:
    """Field names in the order in which the records first show them (Spark sorts the inferred ones).

    One aggregation over all records; a record array is one value, as it is for the reader.
    """
    raw = spark.read.option("encoding", spark_encoding(encoding)).text(path, wholetext=not lines)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    if lines:
        named = raw.select(at.alias("at"), F.posexplode(F.json_object_keys("value")).alias("place", "name"))
    else:
        records = raw.select(at.alias("at"), F.from_json("value", "array<map<string,string>>").alias("records"))
        records = records.select("at", F.posexplode("records").alias("record", "fields"))
        at = F.struct("at", "record")
        named = records.select(at.alias("at"), F.posexplode(F.map_keys("fields")).alias("place", "name"))
    first = named.groupBy("name").agg(F.min(F.struct("at", "place")).alias("first"))
    return [r["name"] for r in first.orderBy("first").select("name").collect()]
