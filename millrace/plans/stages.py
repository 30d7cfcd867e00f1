"""The three stages: clean, encode, engineer. Each returns a new DataFrame and its report."""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions.columns import normalise, ref
from ..operators.dedupe import drop_duplicates_counted
from ..operators.encode import Mapping, encode_columns
from ..operators.facts import Facts
from ..operators.features import correlated_columns, extract_date_features, identifier_columns, low_variance_columns
from ..operators.infer import infer_types
from ..operators.missing import STRATEGIES, fill_missing, high_missing_columns
from ..operators.outliers import handle_outliers
from .config import Settings


class Stage(NamedTuple):
    df: DataFrame
    report: dict
    facts: Facts
    mappings: list[Mapping] = []


def _settings(settings: Settings | None, changes: dict) -> Settings:
    return replace(settings or Settings(), **changes)


def _without(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = set(columns)
    return df.select(*[ref(c) for c in df.columns if c not in gone]) if gone else df


def clean(df: DataFrame, settings: Settings | None = None, facts: Facts | None = None, **changes) -> Stage:
    """Duplicates, types, high-missing columns, missing values, outliers - in this order."""
    s = _settings(settings, changes)
    if s.missing_strategy not in STRATEGIES:
        raise ValueError(f"unknown missing strategy {s.missing_strategy!r}; one of {STRATEGIES}")
    df = df if facts else normalise(df)
    report: dict = {}
    unique, _, report["duplicates_removed"] = drop_duplicates_counted(df)
    facts = facts.derive(unique) if facts and not report["duplicates_removed"] else Facts(unique)

    typed, made = infer_types(unique, facts=facts)
    facts = facts.derive(typed, changed=made)
    if made:
        # Parsed once here, instead of in every later scan of the column.
        facts = facts.stored("typed")
        typed = facts.df

    gone = high_missing_columns(facts, s.missing_threshold)
    report["columns_dropped_high_missing"] = gone
    kept = _without(typed, gone)
    facts = facts.derive(kept)

    filled, report["missing_values_filled"], facts = fill_missing(
        kept, s.missing_strategy, s.missing_fill_value, s.order_by, facts
    )
    out, outliers, facts = handle_outliers(
        filled,
        s.outlier_method,
        s.outlier_action,
        s.iqr_multiplier,
        s.zscore_threshold,
        exclude=s.outlier_exclude,
        facts=facts,
    )
    if outliers is not None:
        report["outliers_handled"] = outliers
    return Stage(out, report, facts)


def encode(df: DataFrame, settings: Settings | None = None, facts: Facts | None = None, **changes) -> Stage:
    s = _settings(settings, changes)
    df = df if facts else normalise(df)
    out, log, mappings, facts = encode_columns(
        df, s.encoding_strategy, s.onehot_max_cardinality, s.drop_first, s.ordinal_categories, s.onehot_guard, facts
    )
    return Stage(out, {"categorical_encoding": log}, facts, mappings)


def engineer(df: DataFrame, settings: Settings | None = None, facts: Facts | None = None, **changes) -> Stage:
    """Date features, then identifier-like, low-variance and correlated columns, each on what is left."""
    s = _settings(settings, changes)
    df = df if facts else normalise(df)
    facts = facts or Facts(df)
    report: dict = {}
    if s.extract_date_features:
        df, report["datetime_features_extracted"], facts = extract_date_features(df, s.drop_datetime_cols, facts)

    def drop(columns: list[str]) -> None:
        nonlocal df, facts
        df = _without(df, columns)
        facts = facts.derive(df)

    if s.drop_identifiers:
        report["identifier_columns_dropped"] = identifier_columns(facts, s.identifier_unique_threshold)
        drop(report["identifier_columns_dropped"])
    if s.drop_low_variance:
        report["low_variance_dropped"] = low_variance_columns(facts, s.variance_threshold)
        drop(report["low_variance_dropped"])
    if s.drop_high_correlation:
        report["high_correlation_dropped"] = correlated_columns(facts, s.correlation_threshold)
        drop(report["high_correlation_dropped"])
    return Stage(df, report, facts)
