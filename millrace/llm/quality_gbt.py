"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are built-in column expressions over the whole text, so texts never
leave the JVM. Trees are grown in numpy on a bounded sample of labelled rows
(``sample_rows``, chosen by hash): values are binned at quantiles, a leaf's split is
found from gradient and Hessian histograms per feature and bin, with a sibling's
histogram by subtraction. The forest is flattened into arrays (feature, threshold,
left, right, value), and batches of rows descend all trees with vectorised gathers.

Defined results: a null text counts as empty and is scored like any other; with no
labelled row, or labels of one kind only, the score is the smoothed share of label 1
(0.5 without any); repeated rows get equal scores; an empty table gives an empty
result; rows without a label, and labels of unknown ids, are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import n_words, words

SAMPLE_ROWS = 40_000


def statistics(text: Column) -> dict[str, Column]:
    """Name and value of each statistic of a text."""
    whole = F.coalesce(text, F.lit(""))
    n = F.length(whole).cast("double")
    per_char = F.greatest(n, F.lit(1.0))
    left = lambda pattern: F.length(F.regexp_replace(whole, pattern, "")).cast("double")
    count = n_words(text).cast("double")
    some = F.greatest(count, F.lit(1.0))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    own = words(text)
    return {
        "log_words": F.log1p(count),
        "chars_per_word": n / some,
        "upper": (n - left("\\p{Lu}+")) / per_char,
        "lower": (n - left("\\p{Ll}+")) / per_char,
        "digits": (n - left("[0-9]+")) / per_char,
        "marks": (n - left("[!?.,;:]+")) / per_char,
        "symbols": (n - left("[#*$%&|<>@^~_=+\\\\/{}\\[\\]]+")) / per_char,
        "lines_per_word": F.size(lines).cast("double") / some,
        "same_lines": 1.0 - F.size(F.array_distinct(lines)).cast("double") / n_lines,
        "distinct_words": F.size(F.array_distinct(own)).cast("double") / some,
    }


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf points to itself, so every row takes ``depth`` steps."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 4096):
            out[i : i + 4096] = 1.0 / (1.0 + np.exp(-np.clip(self.raw(x[i : i + 4096]), -30, 30)))
        return out


def constant(share: float) -> Forest:
    none = np.zeros(0, np.int64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Forest(float(np.log(share / (1 - share))), 0, none, none, np.zeros(0), none, none, np.zeros(0))


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Ascending cut values; bin k holds the values above edge k - 1 and up to edge k."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))
        return values
    return values[:-1]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    shrink: float = 5.0,
    least_rows: int = 8,
) -> Forest:
    """Boosted trees for the logistic loss; ``shrink`` is the L2 weight on leaf values."""
    if len(y) == 0:
        return constant(0.5)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if y.min() == y.max():
        return constant(float(share))
    n, width = x.shape
    edges = [bin_edges(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    offsets = np.arange(width) * bins
    raw = np.full(n, np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def histogram(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        slots = (binned[rows] + offsets).ravel()
        return np.stack(
            [
                np.bincount(slots, weights, width * bins).reshape(width, bins)
                for weights in (np.repeat(grad[rows], width), np.repeat(hess[rows], width), None)
            ]
        )

    def node() -> int:
        at = len(feature)
        feature.append(0), threshold.append(0.0), left.append(at), right.append(at), value.append(0.0)
        return at

    for _ in range(trees):
        prob = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n), histogram(np.arange(n), grad, hess))]
        leaves = []
        for _ in range(depth):
            below = []
            for at, rows, hist in level:
                sums = hist.sum(axis=2)[:, 0]
                part = hist.cumsum(axis=2)[:, :, :-1]
                rest = sums[:, None, None] - part
                gain = part[0] ** 2 / (part[1] + shrink) + rest[0] ** 2 / (rest[1] + shrink)
                gain = np.where((part[2] >= least_rows) & (rest[2] >= least_rows), gain, -np.inf)
                best = int(gain.argmax())
                f, b = divmod(best, bins - 1)
                if not gain[f, b] > sums[0] ** 2 / (sums[1] + shrink) + 1e-9 or b >= len(edges[f]):
                    leaves.append((at, rows))
                    continue
                goes = binned[rows, f] <= b
                feature[at], threshold[at] = f, float(edges[f][b])
                left[at], right[at] = node(), node()
                near, far = rows[goes], rows[~goes]
                small, large = (near, far) if len(near) <= len(far) else (far, near)
                small_hist = histogram(small, grad, hess)
                own = {id(small): small_hist, id(large): hist - small_hist}
                below += [(left[at], near, own[id(near)]), (right[at], far, own[id(far)])]
            level = below
        for at, rows in [*leaves, *((at, rows) for at, rows, _ in level)]:
            value[at] = float(-rate * grad[rows].sum() / (hess[rows].sum() + shrink))
            raw[rows] += value[at]
    arrays = [np.array(v) for v in (feature, threshold, left, right, value)]
    return Forest(float(np.log(share / (1 - share))), depth, np.array(roots), *arrays)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int) -> DataFrame:
    """text and label (``__mr_y``) of about ``rows`` documents with a 0/1 ``label``, chosen by a hash of the id; at most twice as many.

    An id with both labels counts as 1. Of rows that share an id the one whose text has
    the smallest hash stands for all, so repeated rows neither swell the sample nor
    make it depend on their order.
    """
    marks = labels.select(F.col("doc_id").alias("__mr_id"), F.col(label).cast("int").alias("__mr_y"))
    marks = marks.where(F.col("__mr_y").isin(0, 1)).groupBy("__mr_id").agg(F.max("__mr_y").alias("__mr_y"))
    draw = F.pmod(F.xxhash64("__mr_id", F.lit(label)), F.lit(1 << 30))
    n = marks.count()
    share = int(min(1.0, rows / max(n, 1)) * (1 << 30))
    chosen = marks.where(draw < share).limit(2 * rows)
    own = docs.where(learnable).select(F.col("doc_id").alias("__mr_doc"), F.coalesce("text", F.lit("")).alias("text"))
    joined = own.join(F.broadcast(chosen), F.col("__mr_doc") == F.col("__mr_id"))
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    return joined.groupBy("__mr_id").agg(first.alias("text"), F.first("__mr_y").alias("__mr_y"))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    sample = labelled_sample(docs, labels, label, learnable, sample_rows)
    stats = statistics(F.col("text"))
    found = sample.select(F.col("__mr_y"), *[c.alias(k) for k, c in stats.items()]).toPandas()
    found = found.sort_values(list(found.columns), kind="stable")
    return fit(found[list(stats)].to_numpy(float), found["__mr_y"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """Columns ``keep`` of every row, score and predicted."""
    stats = statistics(F.col("text"))
    kept = [F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)]
    own = docs.select(*kept, *[c.alias(f"stat_{k}") for k, c in stats.items()])
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    width = len(stats)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(len(keep) + i).to_numpy() for i in range(width)], axis=1)
            p = forest.probability(x)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"]
            )

    return own.mapInArrow(descend, schema)
