"""The whole run: load, profile, clean, profile, charts, encode, engineer, profile."""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import data_columns, normalise, ref
from ..operators.charts import chart_data
from ..operators.encode import mapping_table
from ..operators.facts import Facts
from ..operators.missing import check_order
from ..operators.profile import QUARTILES, profile
from ..sources.readers import detect_format, load
from ..sources.writers import require_apart, save_report, save_table
from ..workspace import recorded, release
from .config import Settings
from .stages import clean, encode, engineer


class Prepared(NamedTuple):
    df: DataFrame
    report: dict
    charts: dict[str, DataFrame]
    mappings: DataFrame
    scratch: list[str] = []

    def release(self) -> None:
        """Delete the scratch tables behind the result, once it has been written or is no longer needed."""
        release(self.df.sparkSession, self.scratch)


def prepare(
    source: str | DataFrame,
    spark: SparkSession | None = None,
    settings: Settings | None = None,
    load_options: dict | None = None,
    **changes,
) -> Prepared:
    """Turn a file or DataFrame into a model-ready table and a report of every decision.

    Keywords beyond the named ones override fields of ``settings``.
    """
    with recorded() as scratch:
        result = _prepare(source, spark, settings, load_options, changes)
    return result._replace(scratch=scratch)


def _prepare(source, spark, settings, load_options, changes: dict) -> Prepared:
    s = replace(settings or Settings(), **changes)
    if isinstance(source, DataFrame):
        raw, spark = normalise(source), source.sparkSession
    else:
        spark = spark or SparkSession.active()
        raw = _load_for_run(spark, source, s, load_options or {})
    raw_facts = Facts(raw)
    if not isinstance(source, DataFrame) and _is_text(source, load_options or {}):
        # parsed once: every later job reads pruned columns
        raw_facts = raw_facts.stored("load")
        raw = raw_facts.df

    check_order(raw, raw_facts, s.missing_strategy, s.missing_threshold, s.order_by)
    if s.outlier_method == "iqr" and s.outlier_action != "none":
        # Bounds need the quartiles of every numeric column, the profile those of most: one search for both.
        raw_facts.quantiles(raw_facts.columns("numeric"), QUARTILES)
    raw_profile = profile(raw, raw_facts)
    cleaned = clean(raw, s, raw_facts)
    cleaned_profile = profile(cleaned.df, cleaned.facts)

    charts: dict[str, DataFrame] = {}
    if s.visualize:
        charts.update({f"raw:{k}": v for k, v in chart_data(raw, raw_facts, s.series_points).items()})
        charts.update({f"cleaned:{k}": v for k, v in chart_data(cleaned.df, cleaned.facts, s.series_points).items()})

    encoded = encode(cleaned.df, s, cleaned.facts)
    engineered = engineer(encoded.df, s, encoded.facts)
    processed_profile = profile(engineered.df, engineered.facts)
    out = engineered.df.select(*[ref(c) for c in data_columns(engineered.df)])
    report = {
        "raw_profile": raw_profile,
        "cleaned_profile": cleaned_profile,
        "cleaning": cleaned.report,
        "encoding": encoded.report,
        "feature_engineering": engineered.report,
        "processed_profile": processed_profile,
        "charts": list(charts),
        "shapes": {
            name: {"rows": f.rows, "cols": len(f.roles)}
            for name, f in (
                ("loaded", raw_facts),
                ("cleaned", cleaned.facts),
                ("encoded", encoded.facts),
                ("engineered", engineered.facts),
            )
        },
    }
    return Prepared(out, report, charts, mapping_table(spark, encoded.mappings))


def prepare_and_save(
    source: str | DataFrame,
    output: str = "reports/processed_data.csv",
    report_path: str = "reports/report.json",
    **keywords,
) -> Prepared:
    """``prepare``, then write the table (directory of part files) and the JSON report."""
    require_apart(source.inputFiles() if isinstance(source, DataFrame) else [source], output, report_path)
    result = prepare(source, **keywords)
    save_table(result.df, output)
    save_report(result.df.sparkSession, result.report, report_path)
    return result


def _load_for_run(spark: SparkSession, path: str, s: Settings, options: dict) -> DataFrame:
    """Load with row positions where an ordered fill may need them."""
    fill_by_position = s.order_by is None and s.missing_strategy in ("auto", "ffill", "bfill")
    return load(spark, path, **{"keep_position": fill_by_position, **options})


def _is_text(path: str, options: dict) -> bool:
    return (options.get("format") or detect_format(path)) != "parquet"
