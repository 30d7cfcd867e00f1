"""Sinks: the prepared table, the JSON report, the summary of the processed profile."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import data_columns, ref

# Statistics of the summary, in order, with their output names.
SUMMARY = {
    "min": "min", "mean": "mean", "50%": "median", "max": "max", "std": "std", "skewness": "skewness", "kurtosis": "kurtosis",
}


def require_apart(inputs: Iterable[str], *outputs: str) -> None:
    """An output is replaced as a whole, so none may be, hold or lie inside an input."""

    def parts(path: str) -> tuple[str, ...]:
        plain = unquote(urlsplit(path).path) if "://" in path or path.startswith("file:") else posixpath.abspath(path)
        return tuple(p for p in posixpath.normpath(plain).split("/") if p)

    targets = {out: parts(out) for out in outputs}
    for source in inputs:
        own = parts(source)
        for out, target in targets.items():
            n = min(len(own), len(target))
            if own[:n] == target[:n]:
                raise ValueError(f"output {out!r} would overwrite the input {source!r}; choose another path")


def save_table(df: DataFrame, path: str, format: str | None = None, **options) -> None:
    """Write to the directory ``path``, one part file per partition; CSV has a header and no index.

    The format follows the extension of ``path`` (CSV where it has none known). A
    path that overlaps a file ``df`` reads is refused before anything is deleted.
    """
    require_apart(df.inputFiles(), path)
    fmt = format or {".parquet": "parquet", ".json": "json", ".tsv": "tsv"}.get(posixpath.splitext(path)[1].lower(), "csv")
    writer = df.select(*[ref(c) for c in data_columns(df)]).write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        defaults = {"header": True, "escape": '"', "sep": "\t" if fmt == "tsv" else ","}
        writer.options(**{**defaults, **options}).csv(path)
    elif fmt in ("parquet", "json"):
        getattr(writer.options(**options), fmt)(path)
    else:
        raise ValueError(f"unsupported output format {fmt!r}; one of csv, tsv, json, parquet")


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def save_report(spark: SparkSession, report: dict, path: str) -> None:
    """Write the report through Spark, so ``path`` may be on any file system it knows."""
    spark.createDataFrame([(report_json(report),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def summary_table(numeric: DataFrame) -> DataFrame:
    """Selected statistics of the tall numeric summary, rounded half-even to three places."""
    present = [s for s in SUMMARY if s in numeric.columns]
    return numeric.select("column", *[F.bround(ref(s), 3).alias(SUMMARY[s]) for s in present])
