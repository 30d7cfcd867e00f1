"""Order-dependent operators without a global single-partition window.

Rows are cut into key ranges, each processed by its own window partition. Up to
``LITERAL_CUTS`` ranges are cut by literals, so the range of a row is a pure function
of the row. More of them are cut off by row number in the partitions of a distributed
sort and stored with their number, so the size of a range never grows with the table.
Either way a range stays the same in every job and after a lost executor. What crosses a range
border (last value seen, number of values before) is one row per range, carried in two
levels: over groups of ranges first, then inside each group.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import POSITION, data_columns, free_name, ref, replace_columns
from ..workspace import materialise

ROWS_PER_RANGE = 250_000
# Cut points that a projection holds as literals.
LITERAL_CUTS = 4096
# Rows that one task sorts where ranges are cut off by row number; it may hold many ranges.
ROWS_PER_TASK = 500_000
# Ranges that are carried together.
GROUP = 1024
# Keys sampled per range to place the cut points; they affect balance only, never the result.
SAMPLED_KEYS_PER_RANGE = 20


def sql_literal(value, dtype: T.DataType) -> str:
    """SQL text of ``value`` as a literal of ``dtype``; long literal arrays parse faster than they build."""
    if isinstance(dtype, T.StructType):
        fields = zip(dtype.fields, value)
        return "named_struct(" + ", ".join(f"'{f.name}', {sql_literal(v, f.dataType)}" for f, v in fields) + ")"
    kind = dtype.simpleString()
    if value is None:
        return f"cast(null as {kind})"
    if isinstance(value, datetime.datetime):
        value = value.isoformat(sep=" ")
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"cast('{text}' as {kind})"


def order_key(df: DataFrame, order_by: Sequence[str]) -> Column:
    """Sort key of a row; a row hash separates equal keys, so a hot key spreads over several ranges."""
    parts = []
    for c in order_by:
        inner = [ref(c)]
        if c == POSITION:
            inner = [ref(c)[f.name] for f in df.schema[c].dataType.fields]
        parts += inner
    if list(order_by) != [POSITION]:
        parts.append(F.xxhash64(*[ref(c) for c in data_columns(df)]))
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def with_ranges(df: DataFrame, key: Column, rows: int, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, str, str]:
    """Add the key and its range number; returns (df, key name, range name)."""
    key_name, range_name = free_name("__key", df.columns), free_name("__range", df.columns)
    keyed = df.withColumn(key_name, key)
    n = max(1, math.ceil(rows / rows_per_range))
    if n == 1:
        return keyed.withColumn(range_name, F.lit(0)), key_name, range_name
    if n > LITERAL_CUTS:
        # Spark sends some hundred sampled keys per partition to the driver, so partitions follow the
        # rows, not the ranges. Row ids grow along the sorted partitions; storing fixes what the sample gave.
        tasks = math.ceil(rows / max(ROWS_PER_TASK, rows_per_range))
        dealt = keyed.repartitionByRange(tasks, ref(key_name)).sortWithinPartitions(ref(key_name))
        numbered = dealt.withColumn(range_name, F.expr(f"monotonically_increasing_id() div {rows_per_range}"))
        return materialise(numbered, "ranges"), key_name, range_name
    cuts = _cut_points(keyed.select(key_name), n, rows)
    dtype = keyed.schema[key_name].dataType
    # The first key field alone places a row, unless some value of it is hot enough to be cut twice.
    leading = [c[0] for c in cuts]
    if None not in leading and len(set(leading)) == len(leading):
        return _number_ranges(keyed, ref(key_name)["k0"], leading, dtype.fields[0].dataType, range_name), key_name, range_name
    return _number_ranges(keyed, ref(key_name), cuts, dtype, range_name), key_name, range_name


def _block_ranges(df: DataFrame) -> tuple[DataFrame, str, str]:
    """Ranges of the row position: its file and block. Their size is that of a split, whatever the table's."""
    key_name, range_name = free_name("__key", df.columns), free_name("__range", df.columns)
    at = ref(POSITION)
    keyed = df.withColumn(key_name, order_key(df, [POSITION]))
    return keyed.withColumn(range_name, F.struct(at["file"].alias("file"), at["block"].alias("block"))), key_name, range_name


def _cut_points(keys: DataFrame, n: int, rows: int) -> list:
    share = min(1.0, n * SAMPLED_KEYS_PER_RANGE / rows)
    name = keys.columns[0]
    # Ordered on the cluster; about n * SAMPLED_KEYS_PER_RANGE keys reach the driver.
    sample = [r[0] for r in keys.sample(share, seed=11).orderBy(ref(name)).collect()]
    cuts = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def _number_ranges(df: DataFrame, key: Column, cuts: list, dtype: T.DataType, name: str) -> DataFrame:
    """Range number = number of cut points at or below the key, found in three narrowing steps.

    Each step is a projection of its own, so none is evaluated twice.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    s = math.ceil(len(cuts) ** (1 / 3))

    def points(values) -> Column:
        return F.expr("array(" + ", ".join(sql_literal(v, dtype) for v in values) + ")")

    def reached(candidates: Column) -> Column:
        return F.size(F.filter(candidates, lambda cut: cut <= key))

    def narrowed(at: Column, values) -> Column:
        start = (at - 1) * s
        return F.when(at == 0, F.lit(0)).otherwise(start + reached(F.slice(points(values), start + 1, F.lit(s))))

    coarse, middle = free_name("__coarse", df.columns), free_name("__middle", df.columns)
    return (
        df.withColumn(coarse, reached(points(cuts[:: s * s])))
        .withColumn(middle, narrowed(F.col(coarse), cuts[::s]))
        .withColumn(name, narrowed(F.col(middle), cuts))
        .drop(coarse, middle)
    )


def _carried(edges: DataFrame, rng: str, values: dict[str, Column], fold, few: bool, forward: bool = True) -> DataFrame:
    """Per range the ``fold`` of ``values`` over all ranges before it (after it if not ``forward``).

    Ranges are grouped by file where they are blocks of files, else by their number; one
    row per group is carried in one task, one row per range inside its group. ``few``
    ranges are one group.
    """
    if few:
        outward = Window.orderBy(ref(rng) if forward else ref(rng).desc()).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0) if fold is F.sum else F.lit(None)
        carried = [F.coalesce(fold(v).over(outward), zero).alias(name) for name, v in values.items()]
        return edges.select(ref(rng).alias("__carry_range"), *carried)
    blocks = isinstance(edges.schema[rng].dataType, T.StructType)
    group = ref(rng)["file"] if blocks else F.floor(ref(rng) / GROUP)
    grouped = edges.withColumn("__carry_group", group)

    def along(window, column: str) -> Window:
        return window.orderBy(ref(column) if forward else ref(column).desc())

    inside = along(Window.partitionBy("__carry_group"), rng)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = grouped.select(
        "__carry_group",
        ref(rng).alias("__carry_range"),
        *[fold(v).over(earlier).alias(f"__in{i}") for i, v in enumerate(values.values())],
        *[fold(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__all{i}") for i, v in enumerate(values.values())],
    )
    last = F.max_by if forward else F.min_by
    groups = upto.groupBy("__carry_group").agg(*[last(f"__all{i}", "__carry_range").alias(f"__all{i}") for i in range(len(values))])
    before = along(Window, "__carry_group").rowsBetween(Window.unboundedPreceding, -1)
    tops = groups.select("__carry_group", *[fold(F.col(f"__all{i}")).over(before).alias(f"__top{i}") for i in range(len(values))])
    joined = upto.join(tops, "__carry_group")
    return joined.select("__carry_range", *[_joined(fold, i).alias(name) for i, name in enumerate(values)])


def _last_value(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def _joined(fold, i: int) -> Column:
    if fold is F.sum:
        return F.coalesce(F.col(f"__in{i}"), F.lit(0)) + F.coalesce(F.col(f"__top{i}"), F.lit(0))
    return F.coalesce(F.col(f"__in{i}"), F.col(f"__top{i}"))


def ordered_fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    direction: str = "forward",
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Replace nulls by the nearest earlier (``forward``) or later (``backward``) value in key order."""
    if direction not in ("forward", "backward"):
        raise ValueError(f"direction must be forward or backward, not {direction!r}")
    rows = df.count() if rows is None else rows
    forward = direction == "forward"
    if list(order_by) == [POSITION]:
        ranged, key, rng = _block_ranges(df)
    else:
        ranged, key, rng = with_ranges(df, order_key(df, order_by), rows, rows_per_range)

    nearest = F.max_by if forward else F.min_by
    edges = ranged.groupBy(rng).agg(
        *[nearest(ref(c), F.when(ref(c).isNotNull(), ref(key))).alias(f"edge{i}") for i, c in enumerate(columns)]
    )
    # One row per range from here to the join.
    names = {f"__carry{i}": F.col(f"edge{i}") for i in range(len(columns))}
    few = rows <= LITERAL_CUTS * rows_per_range and list(order_by) != [POSITION]
    carry = _carried(edges, rng, names, _last_value, few, forward)
    # A growing frame in key order; backward walks the descending key, as a shrinking frame is quadratic.
    local = (
        Window.partitionBy(rng)
        .orderBy(ref(key) if forward else ref(key).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = ranged.join(F.broadcast(carry) if few else carry, F.col(rng) == F.col("__carry_range"), "left")
    new = {
        c: F.coalesce(F.last(ref(c), ignorenulls=True).over(local), F.col(f"__carry{i}")) for i, c in enumerate(columns)
    }
    return replace_columns(joined, new).select(*[ref(c) for c in df.columns])


def dense_codes(values: DataFrame, rows: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(value, ...) of distinct values -> the same with ``code``, the 0-based rank of the value."""
    ranged, key, rng = with_ranges(values, F.struct(F.col("value").alias("k0")), rows, rows_per_range)
    sizes = ranged.groupBy(rng).agg(F.count(F.lit(1)).alias("n"))
    few = rows <= LITERAL_CUTS * rows_per_range
    starts = _carried(sizes, rng, {"__start": F.col("n")}, F.sum, few)
    local = Window.partitionBy(rng).orderBy(ref(key))
    placed = ranged.withColumn("__at", F.row_number().over(local) - 1)
    joined = placed.join(F.broadcast(starts) if few else starts, F.col(rng) == F.col("__carry_range"), "left")
    return joined.select(*[ref(c) for c in values.columns], (F.col("__start") + F.col("__at")).alias("code"))
