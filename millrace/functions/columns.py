"""Column roles, name handling and the load-time normalisation projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Reserved name of the hidden row-position column (see sources.readers).
POSITION = "__position"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def ref(name: str) -> Column:
    """Column by exact name; dots and spaces are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POSITION]


def role(dtype: T.DataType) -> str:
    if isinstance(dtype, _NUMERIC):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(dtype, _TEMPORAL):
        return "temporal"
    return "other"


def roles(df: DataFrame) -> dict[str, str]:
    """Column name -> role, in column order; the hidden position is left out."""
    return {f.name: role(f.dataType) for f in df.schema.fields if f.name != POSITION}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, r in roles(df).items() if r in wanted]


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _INTEGRAL)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, suffixed _1, _2 ... until no column resolves to it (names are case-insensitive)."""
    used = {t.lower() for t in taken}
    candidate, i = name, 0
    while candidate.lower() in used:
        i += 1
        candidate = f"{name}_{i}"
    return candidate


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns in place."""
    if not new:
        return df
    return df.select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])


def normalise(df: DataFrame, stringify_nested: bool = True) -> DataFrame:
    """NaN -> null, decimal -> double, date and zoned time -> timestamp_ntz, nested -> JSON text.

    A zoned time becomes the wall clock of the session's zone, so no later step
    depends on where the driver stands.
    """
    new: dict[str, Column] = {}
    for field in df.schema.fields:
        if field.name == POSITION:
            continue
        c, t = ref(field.name), field.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            new[field.name] = F.when(~F.isnan(c), c)
        elif isinstance(t, T.DecimalType):
            new[field.name] = c.cast("double")
        elif isinstance(t, (T.DateType, T.TimestampType)):
            new[field.name] = c.cast("timestamp_ntz")
        elif isinstance(t, _NESTED) and stringify_nested:
            new[field.name] = F.to_json(c)
    return replace_columns(df, new)
