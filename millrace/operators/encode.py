"""Categorical encodings."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import columns_of, free_name, ref, replace_columns
from ..workspace import materialise
from .counts import LONG_TEXT_BYTES, value_counts
from .facts import Facts
from .ordered import dense_codes

# Names of the strategies.
STRATEGIES = ("auto", "onehot", "label", "frequency", "ordinal")
# Text a missing entry takes in label encoding (fixed value).
MISSING_LABEL = "<NA>"
# Mappings up to this size become a literal map in the projection.
INLINE_LEVELS = 100
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes one broadcast row costs beside its text.
_ROW_BYTES = 64
# A value that holds more than one row in this many counts as hot.
_HOT_SHARE = 2000
# No key with more rows than this is left to a shuffle partition.
_COLD_ROWS = 2_000_000
ONEHOT_GUARD = 1000


@dataclass(frozen=True)
class Mapping:
    """value -> code of one column: as a small dict, or as a DataFrame (value, n, code)."""

    column: str
    entries: dict[str, float] | None
    table: DataFrame | None = None
    n_rows: int = 0
    n_unique: int = 0
    n_bytes: int = 0

    @property
    def broadcastable(self) -> bool:
        long_texts = self.n_bytes > LONG_TEXT_BYTES * self.n_unique
        return (32 * self.n_unique if long_texts else self.n_bytes) + self.n_unique * _ROW_BYTES <= BROADCAST_BYTES


def plan_kinds(
    cardinality: dict[str, int], strategy: str = "auto", limit: int = 10, listed: Collection[str] = ()
) -> dict[str, str]:
    """Column -> kind of encoding, for all columns at once.

    One named strategy holds for all. ``auto`` starts from frequency codes; small
    columns (``limit`` values, also none or one) get dummies, of those the
    two-valued a label, and columns with a listed order keep that order.
    """
    if strategy != "auto":
        return dict.fromkeys(cardinality, strategy)
    kinds = dict.fromkeys(cardinality, "frequency")
    kinds |= {c: "onehot" for c, n in cardinality.items() if n <= limit}
    kinds |= {c: "label" for c, n in cardinality.items() if n == 2}
    kinds |= {c: "ordinal" for c in cardinality if c in listed}
    return kinds


# -- one-hot ------------------------------------------------------------------


def onehot_columns(column: str, values: Sequence[str], taken: Sequence[str], drop_first: bool = True) -> dict[str, Column]:
    """New column name -> 0/1 expression, in category order; a missing entry is 0 everywhere."""
    out: dict[str, Column] = {}
    for v in list(values)[1 if drop_first else 0 :]:
        name = free_name(f"{column}_{v}", [*taken, *out])
        out[name] = F.coalesce(ref(column) == F.lit(v), F.lit(False)).cast("int")
    return out


def onehot(df: DataFrame, column: str, drop_first: bool = True, guard: int | None = ONEHOT_GUARD, facts: Facts | None = None) -> DataFrame:
    values = category_list(facts or Facts(df), column, guard)
    others = [c for c in df.columns if c != column]
    new = onehot_columns(column, values, others, drop_first)
    return df.select(*[ref(c) for c in others], *[e.alias(n) for n, e in new.items()])


def category_list(facts: Facts, column: str, guard: int | None = ONEHOT_GUARD) -> list[str]:
    known = facts.levels([column])[column]
    if guard is not None and known.n_unique > guard:
        raise ValueError(
            f"one-hot encoding of {column!r} would add {known.n_unique} columns (limit {guard}); "
            "use frequency or label encoding, or raise onehot_guard"
        )
    if not known.complete:
        known = facts.levels([column], k=known.n_unique)[column]
    return known.sorted_values()


# -- codes --------------------------------------------------------------------


def _mapping(facts: Facts, column: str, code: str, missing_label: bool = False) -> Mapping:
    """``code`` is 'rank' (place in value order) or 'share' (part of the non-null rows)."""
    known = facts.levels([column])[column]
    if INLINE_LEVELS >= known.n_unique and not known.complete:
        known = facts.levels([column], k=INLINE_LEVELS)[column]
    if known.complete:
        if code == "share":
            return Mapping(column, {v: n / known.n_rows for v, n in known.top})
        values = set(known.sorted_values())
        if missing_label and facts.nulls()[column]:
            values.add(MISSING_LABEL)
        return Mapping(column, {v: i for i, v in enumerate(sorted(values))})
    source = facts.df
    if missing_label:
        source = source.select(F.coalesce(ref(column), F.lit(MISSING_LABEL)).alias(column))
    counts = value_counts(source, [column]).select("value", "n")
    if code == "share":
        # stored, as every later job that touches the column looks it up
        table = materialise(counts.withColumn("code", F.col("n") / F.lit(float(known.n_rows))), "shares")
    else:
        table = dense_codes(materialise(counts, "codes"), known.n_unique + 1)
    return Mapping(column, None, table, facts.rows, known.n_unique, known.n_bytes)


def _inline(column: Column, entries: dict, dtype: str) -> Column:
    if not entries:
        return F.lit(None).cast(dtype)
    pairs = [x for v, k in entries.items() for x in (F.lit(v), F.lit(k).cast(dtype))]
    return F.try_element_at(F.create_map(*pairs), column)


def lookup(df: DataFrame, column: str, key: Column, mapping: DataFrame, n_rows: int, n_unique: int, n_bytes: int) -> DataFrame:
    """Replace ``column`` by the code ``mapping`` (value, n, code) has for ``key``; null where it has none.

    A mapping of known small size is broadcast. A larger one is joined by
    shuffle, after the rows of missing and hot keys were served from a broadcast
    of the hot entries alone (at most one per _COLD_ROWS rows, or _HOT_SHARE), so no key floods a task.
    """
    key_name, code_name = free_name("__lookup_key", df.columns), free_name("__lookup_code", df.columns)
    # Long texts meet by digest: neither a broadcast nor a shuffle carries the texts.
    digest = F.md5 if n_bytes > LONG_TEXT_BYTES * n_unique else lambda c: c
    left = df.withColumn(key_name, digest(key))

    def entries(part: DataFrame) -> DataFrame:
        return part.select(digest(F.col("value")).alias("__lookup_value"), F.col("code").alias(code_name))

    if digest is F.md5:
        n_bytes = 32 * n_unique

    def finish(joined: DataFrame) -> DataFrame:
        return joined.select(*[ref(code_name).alias(c) if c == column else ref(c) for c in df.columns])

    match = ref(key_name) == F.col("__lookup_value")
    if n_bytes + n_unique * _ROW_BYTES <= BROADCAST_BYTES:
        return finish(left.join(F.broadcast(entries(mapping)), match, "left"))
    # the second limit bounds the rows of a cold key, and the hot entries to a row in so many
    is_hot = F.col("n") >= max(min(n_rows // _HOT_SHARE, _COLD_ROWS), 1)
    hot = F.broadcast(entries(mapping.where(is_hot)))
    served = left.join(hot, match, "left").where(ref(key_name).isNull() | F.col("__lookup_value").isNotNull())
    cold = (
        left.where(ref(key_name).isNotNull())
        .join(hot, match, "left_anti")
        .join(entries(mapping.where(~is_hot)), match, "left")
    )
    return finish(served).unionByName(finish(cold))


@dataclass(frozen=True)
class Codes:
    """How one column becomes codes: the key that is looked up, the type, and the code of an absent key."""

    mapping: Mapping
    key: Column
    dtype: str
    absent: float | None = None

    def finish(self, code: Column) -> Column:
        code = code.cast(self.dtype)
        return code if self.absent is None else F.coalesce(code, F.lit(self.absent).cast(self.dtype))

    def inline(self) -> Column | None:
        """The codes as an expression; None for mappings that need a join."""
        m = self.mapping
        return None if m.entries is None else self.finish(_inline(self.key, m.entries, self.dtype))


def _label_codes(facts: Facts, column: str) -> Codes:
    return Codes(_mapping(facts, column, "rank", True), F.coalesce(ref(column), F.lit(MISSING_LABEL)), "bigint")


def _frequency_codes(facts: Facts, column: str) -> Codes:
    return Codes(_mapping(facts, column, "share"), ref(column), "double")


def _ordinal_codes(facts: Facts, column: str, order: Sequence[str] | None) -> Codes:
    if order is None:
        return Codes(_mapping(facts, column, "rank"), ref(column), "double", -1.0)
    places: dict[str, float] = {}
    for i, v in enumerate(order):
        places.setdefault(str(v), float(i))
    return Codes(Mapping(column, places), ref(column), "double", -1.0)


def _coded(df: DataFrame, codes: Sequence[Codes]) -> DataFrame:
    """All columns coded: joins for large mappings, then one projection for everything."""
    new: dict[str, Column] = {}
    out, shuffled = df, False
    for c in codes:
        m, code = c.mapping, c.inline()
        if code is None:
            out = lookup(out, m.column, c.key, m.table, m.n_rows, m.n_unique, m.n_bytes)
            code = c.finish(ref(m.column))
            shuffled |= not m.broadcastable
        new[m.column] = code
    out = replace_columns(out, new)
    # a join by shuffle runs once, not in every later job
    return materialise(out, "coded") if shuffled else out


def label(df: DataFrame, column: str, facts: Facts | None = None) -> tuple[DataFrame, Mapping]:
    """0-based rank of the text among the sorted texts; a missing entry counts as the text <NA>."""
    codes = _label_codes(facts or Facts(df), column)
    return _coded(df, [codes]), codes.mapping


def frequency(df: DataFrame, column: str, facts: Facts | None = None) -> tuple[DataFrame, Mapping]:
    """Share of the value among the non-null rows; a missing entry stays null."""
    codes = _frequency_codes(facts or Facts(df), column)
    return _coded(df, [codes]), codes.mapping


def ordinal(df: DataFrame, column: str, order: Sequence[str] | None = None, facts: Facts | None = None) -> tuple[DataFrame, Mapping]:
    """Place in ``order`` (sorted values where none is given); unknown and missing entries are -1."""
    codes = _ordinal_codes(facts or Facts(df), column, order)
    return _coded(df, [codes]), codes.mapping


# -- all categorical columns ----------------------------------------------------


def encode_columns(
    df: DataFrame,
    strategy: str = "auto",
    onehot_max_cardinality: int = 10,
    drop_first: bool = True,
    ordinal_categories: dict[str, Sequence[str]] | None = None,
    onehot_guard: int | None = ONEHOT_GUARD,
    facts: Facts | None = None,
) -> tuple[DataFrame, dict[str, dict], list[Mapping], Facts]:
    """Encode every categorical column; dummies go to the end, all other codes replace their column."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown encoding strategy {strategy!r}; one of {STRATEGIES}")
    orders = ordinal_categories or {}
    facts = facts or Facts(df)
    columns = columns_of(df, "categorical")
    known = facts.levels(columns, max(15, onehot_max_cardinality))
    kinds = plan_kinds({c: known[c].n_unique for c in columns}, strategy, onehot_max_cardinality, orders)
    codes: dict[str, Codes] = {}
    dummies: dict[str, Column] = {}
    mappings: list[Mapping] = []
    for c, kind in kinds.items():
        if kind == "onehot":
            values = category_list(facts, c, onehot_guard)
            dummies |= onehot_columns(c, values, [*(k for k in df.columns if k != c), *dummies], drop_first)
            mappings.append(Mapping(c, {v: i for i, v in enumerate(values)}))
            continue
        make = {"label": _label_codes, "frequency": _frequency_codes}
        codes[c] = make[kind](facts, c) if kind in make else _ordinal_codes(facts, c, orders.get(c))
        mappings.append(codes[c].mapping)
    expanded = [c for c, kind in kinds.items() if kind == "onehot"]
    out = _coded(df, list(codes.values()))
    if expanded:
        out = out.select(*[ref(c) for c in out.columns if c not in expanded], *[e.alias(n) for n, e in dummies.items()])
    report = {c: {"strategy": kinds[c], "n_unique": known[c].n_unique} for c in columns}
    return out, report, mappings, facts.derive(out, changed=columns)


def mapping_table(spark, mappings: Sequence[Mapping]) -> DataFrame:
    """Tall (column, value, code) of all fitted encodings."""
    small = [(m.column, v, float(k)) for m in mappings if m.entries is not None for v, k in m.entries.items()]
    out = spark.createDataFrame(small, "column string, value string, code double")
    for m in mappings:
        if m.table is not None:
            out = out.unionByName(m.table.select(F.lit(m.column).alias("column"), "value", F.col("code").cast("double").alias("code")))
    return out
