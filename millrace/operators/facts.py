"""Memoised facts about one DataFrame.

Profile, charts, cleaning and feature decisions ask for the same statistics. A
``Facts`` object computes each at most once, for all columns together, and hands
the untouched ones on to the DataFrame of the next stage (``derive``), so a
stage that changes two columns costs scans of two columns. Where a stage stores its
table anyway, the first pass over it rides along with the write (``stored``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import columns_of, ref, roles
from ..workspace import materialise_observed
from .correlate import centred_sums, pearson
from .counts import LONG_TEXT_BYTES, Levels, distinct_share_reaches, levels, long_text_levels
from .measure import measure
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Scan:
    """First-pass facts of a column; the fields beyond ``present`` depend on its role."""

    present: int
    mean: float | None = None
    lo: Any = None
    hi: Any = None
    binary: bool = False
    bytes: int = 0
    hours: tuple[int | None, int | None] = (None, None)


class Facts:
    def __init__(self, df: DataFrame):
        self.df = df
        self.roles = roles(df)
        self._rows: int | None = None
        self._scan: dict[str, Scan] = {}
        self._powers: dict[str, tuple[float, float, float]] = {}
        self._quantiles: dict[tuple[str, float], float | None] = {}
        self._unique: dict[tuple[str, float], bool] = {}
        self._levels: dict[str, Levels] = {}
        self._pearson: dict[tuple[str, str], float | None] = {}

    def columns(self, *wanted: str) -> list[str]:
        return columns_of(self.df, *wanted)

    def derive(self, df: DataFrame, changed: Iterable[str] = ()) -> "Facts":
        """Facts of ``df``, which has the same rows and differs in ``changed`` (and new or dropped) columns."""
        if df is self.df:
            return self
        new = Facts(df)
        keep = {c for c in new.roles if self.roles.get(c) == new.roles[c]} - set(changed)
        new._rows = self._rows
        new._scan = {c: s for c, s in self._scan.items() if c in keep}
        new._powers = {c: p for c, p in self._powers.items() if c in keep}
        new._quantiles = {k: q for k, q in self._quantiles.items() if k[0] in keep}
        new._unique = {k: u for k, u in self._unique.items() if k[0] in keep}
        new._levels = {c: v for c, v in self._levels.items() if c in keep}
        new._pearson = {k: r for k, r in self._pearson.items() if set(k) <= keep}
        return new

    # -- first pass -------------------------------------------------------

    def scan(self) -> dict[str, Scan]:
        exprs = self._scan_measures()
        if exprs:
            self._take_scan(measure(self.df, exprs))
        return self._scan

    def stored(self, label: str) -> "Facts":
        """Facts of the table once it is stored; those of the first pass are gathered while it is written."""
        df, got = materialise_observed(self.df, label, self._scan_measures())
        new = self.derive(df)
        new._take_scan(got)
        return new

    def _scan_measures(self) -> dict:
        """What the first pass has to find: nothing where it has been made."""
        todo = [c for c in self.roles if c not in self._scan]
        if not todo and self._rows is not None:
            return {}
        exprs: dict = {"rows": F.count(F.lit(1))} if self._rows is None else {}
        for c in todo:
            v = ref(c)
            exprs[c, "present"] = F.count(v)
            if self.roles[c] == "numeric":
                exprs[c, "mean"] = F.avg(v.cast("double"))
                exprs[c, "lo"], exprs[c, "hi"] = F.min(v), F.max(v)
                exprs[c, "binary"] = F.coalesce(F.bool_and(v.isin(0, 1)), F.lit(True))
            elif self.roles[c] == "categorical":
                exprs[c, "bytes"] = F.sum(F.octet_length(v))
            elif self.roles[c] == "temporal":
                exprs[c, "lo"], exprs[c, "hi"] = F.min(v), F.max(v)
                exprs[c, "hour_lo"], exprs[c, "hour_hi"] = F.min(F.hour(v)), F.max(F.hour(v))
        return exprs

    def _take_scan(self, got: dict) -> None:
        self._rows = got.get("rows", self._rows)
        for c in {key[0]: None for key in got if key != "rows"}:
            fields = {name: got.get((c, name)) for name in ("mean", "lo", "hi")}
            self._scan[c] = Scan(
                present=got[c, "present"],
                binary=bool(got.get((c, "binary"), False)),
                bytes=got.get((c, "bytes")) or 0,
                hours=(got.get((c, "hour_lo")), got.get((c, "hour_hi"))),
                **fields,
            )

    @property
    def rows(self) -> int:
        if self._rows is None:
            self.scan()
        return self._rows

    def nulls(self) -> dict[str, int]:
        scan = self.scan()
        return {c: self.rows - scan[c].present for c in self.roles}

    # -- moments ----------------------------------------------------------

    def powers(self, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
        """Sums of the 2nd, 3rd and 4th powers of the distance from the mean."""
        scan = self.scan()
        todo = [c for c in columns if c not in self._powers]
        # A constant column has none, whatever rounding its mean carries.
        flat = {c for c in todo if scan[c].lo == scan[c].hi}
        self._powers.update({c: (0.0, 0.0, 0.0) for c in flat})
        live = [c for c in todo if c not in flat]
        if live:
            # Plain sums around a known mean stay inside generated code.
            exprs = {}
            for c in live:
                d = ref(c).cast("double") - F.lit(scan[c].mean)
                exprs[c, 2], exprs[c, 3], exprs[c, 4] = F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d)
            got = measure(self.df, exprs)
            self._powers.update({c: (got[c, 2], got[c, 3], got[c, 4]) for c in live})
        return {c: self._powers[c] for c in columns}

    def std(self, columns: Sequence[str], ddof: int = 1) -> dict[str, float | None]:
        powers, scan = self.powers(columns), self.scan()
        return {
            c: math.sqrt(powers[c][0] / (scan[c].present - ddof)) if scan[c].present > ddof else None for c in columns
        }

    def skewness(self, column: str) -> float | None:
        """Bias-corrected; 0 for a constant column, None below three values."""
        n, (s2, s3, _) = self.scan()[column].present, self.powers([column])[column]
        if n < 3:
            return None
        if s2 == 0 or not math.isfinite(s2):
            return 0.0 if s2 == 0 else None
        return (s3 / n) / (s2 / n) ** 1.5 * math.sqrt(n * (n - 1.0)) / (n - 2.0)

    def kurtosis(self, column: str) -> float | None:
        """Bias-corrected excess; 0 for a constant column, None below four values."""
        n, (s2, _, s4) = self.scan()[column].present, self.powers([column])[column]
        if n < 4:
            return None
        if s2 == 0 or not math.isfinite(s2):
            return 0.0 if s2 == 0 else None
        excess = (s4 / n) / (s2 / n) ** 2 - 3.0
        return (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * excess + 6.0)

    # -- order statistics, uniqueness, categories, correlation -------------

    def quantiles(self, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
        todo = [c for c in columns if any((c, p) not in self._quantiles for p in probs)]
        if todo:
            scan = self.scan()
            counts = {c: scan[c].present for c in todo}
            ends = {c: (float(scan[c].lo), float(scan[c].hi)) for c in todo if scan[c].present}
            for c, values in exact_quantiles(self.df, todo, probs, counts, ends).items():
                self._quantiles.update({(c, p): v for p, v in zip(probs, values)})
        return {c: [self._quantiles[c, p] for p in probs] for c in columns}

    def mostly_unique(self, columns: Sequence[str], threshold: float = 0.95, min_rows: int = 11) -> dict[str, bool]:
        """Share of distinct values (nulls count as rows) at or above ``threshold``."""
        if self.rows < max(min_rows, 1):
            return {c: False for c in columns}
        todo = []
        for c in columns:
            if (c, threshold) in self._unique:
                continue
            if c in self._levels:
                self._unique[c, threshold] = self._levels[c].n_unique / self.rows >= threshold
            else:
                todo.append(c)
        if todo:
            scan = self.scan()
            ends = {c: (scan[c].lo, scan[c].hi) for c in todo}
            got = distinct_share_reaches(self.df, todo, self.rows, threshold, ends)
            self._unique.update({(c, threshold): u for c, u in got.items()})
        return {c: self._unique[c, threshold] for c in columns}

    def known_levels(self) -> dict[str, Levels]:
        return dict(self._levels)

    def levels(self, columns: Sequence[str], k: int = 15) -> dict[str, Levels]:
        todo = [c for c in columns if c not in self._levels or (self._levels[c].k < k and not self._levels[c].complete)]
        if todo:
            scan = self.scan()
            long = [c for c in todo if scan[c].bytes > LONG_TEXT_BYTES * scan[c].present]
            self._levels.update(levels(self.df, [c for c in todo if c not in long], k))
            self._levels.update({c: long_text_levels(self.df, c, k) for c in long})
        return {c: self._levels[c] for c in columns}

    def pearson(self, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
        """r of every pair (i before j, in the order given); None where undefined."""
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        todo = [p for p in pairs if p not in self._pearson]
        if todo:
            scan, nulls = self.scan(), self.nulls()
            sums = centred_sums(
                self.df,
                todo,
                means={c: scan[c].mean for c in columns},
                with_nulls={c for c in columns if nulls[c]},
                rows=self.rows,
            )
            self._pearson.update({p: pearson(s) for p, s in sums.items()})
        return {p: self._pearson[p] for p in pairs}
