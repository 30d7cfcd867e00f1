"""Tabular data preparation on Spark DataFrames."""

from .operators.charts import chart_data
from .operators.facts import Facts
from .operators.profile import profile
from .plans.config import Settings
from .plans.prepare import Prepared, prepare, prepare_and_save
from .plans.stages import Stage, clean, encode, engineer
from .sources.readers import load, preview
from .sources.writers import save_report, save_table

__all__ = [
    "Facts", "Prepared", "Settings", "Stage", "chart_data", "clean", "encode", "engineer",
    "load", "prepare", "prepare_and_save", "preview", "profile", "save_report", "save_table",
]
