"""Settings of a preparation run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any


# Names of the settings and their defaults.
@dataclass(frozen=True)
class Settings:
    # cleaning
    missing_strategy: str = "auto"
    missing_fill_value: Any = None
    missing_threshold: float = 0.5
    outlier_method: str = "iqr"
    outlier_action: str = "clip"
    zscore_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    outlier_exclude: Sequence[str] = ()
    # encoding
    encoding_strategy: str = "auto"
    onehot_max_cardinality: int = 10
    drop_first: bool = True
    ordinal_categories: dict[str, Sequence[str]] = field(default_factory=dict)
    # most categories a one-hot column may have; None: any number
    onehot_guard: int | None = 1000
    # features
    extract_date_features: bool = True
    drop_datetime_cols: bool = True
    drop_identifiers: bool = True
    identifier_unique_threshold: float = 0.95
    drop_low_variance: bool = True
    # compared with the standard deviation, despite its name
    variance_threshold: float = 0.01
    drop_high_correlation: bool = True
    correlation_threshold: float = 0.95
    # charts
    visualize: bool = True
    # time series: None keeps every row, a number averages over so many equal time slices
    series_points: int | None = None
    # order of rows for ffill / bfill; None: position in the source files
    order_by: Sequence[str] | None = None
