"""Scratch tables in the shared checkpoint folder.

A stage that shuffles or parses text is written out once, so later jobs re-read
pruned parquet columns instead of repeating the work, and a lost executor costs
a re-read of files only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Hashable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_RECORDS: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names.

    A private folder stands in only where driver and executors are one process
    (a ``local`` master); elsewhere a machine-local folder would be invisible to
    the other machines, so an unset folder is an error. The session is not changed.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="millrace-")
        root = _LOCAL_ROOTS[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str, suffix: str = "") -> str:
    return f"{scratch_root(spark)}/millrace-{label}-{uuid.uuid4().hex}{suffix}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet, return a scan of it."""
    return materialise_observed(df, label, {})[0]


def materialise_observed(df: DataFrame, label: str, measures: dict[Hashable, Column]) -> tuple[DataFrame, dict[Hashable, Any]]:
    """The same, with the values that aggregate ``measures`` have over the rows as they are written.

    The measures stand in the tasks that write, behind every shuffle: such a task counts
    once, however often stages before it have to be run again.
    """
    path = scratch_path(df.sparkSession, label)
    for record in _RECORDS:
        record.append(path)
    observed, seen = df, None
    if measures:
        seen = Observation()
        observed = df.observe(seen, *[m.alias(f"m{i}") for i, m in enumerate(measures.values())])
    observed.write.parquet(path)
    got = {} if seen is None else {key: seen.get[f"m{i}"] for i, key in enumerate(measures)}
    return df.sparkSession.read.schema(df.schema).parquet(path), got


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the scratch tables that are written while the block runs."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS.remove(record)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables; whatever reads them can no longer be run."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
