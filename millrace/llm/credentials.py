"""Secret scan with corpus-wide ownership frequency.

Base spans are what fixed patterns find. Beyond them, long mixed-class tokens are
candidates. A candidate's value is hashed, and over the whole corpus the distinct
repositories and owners that hold the hash are counted: a value that many owners
share is a copied example, one that a single owner (or few) holds and that looks
random is a live-looking credential. Where owners are not given, only stood for by
sources, a value in many distinct texts is copied as well. Live-looking candidates become additional
spans; base spans always stay and carry the same verdict in ``live``.

Defined results: null and empty texts have no spans; a null repository or owner is
one of its own; repeated rows get equal spans and count as one owner; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_slices, materialise, skew_join

# The base patterns; kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# What the method adds: long runs that mix upper case, lower case and digits.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_BITS = 3.5
# A value held by more owners than this is an example, not a credential.
MOST_OWNERS = 2
# Without owners and repositories of its own, a value in more distinct texts than this is an example too.
MOST_TEXTS = 8

# Long runs of hexadecimal digits without trying every position of ordinary words.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)

Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end, value), leftmost and non-overlapping per kind, too short ones dropped."""
    found = [("assign", *m.span(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # runs are maximal, so the long ones are the same without a look at the short ones
    found += [("hex", *m.span(), m.group()) for m in _LONG_HEX.finditer(text)]
    return found


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def added_candidates(text: str, base: list[Span]) -> list[Span]:
    """Random-looking tokens outside the base spans; one sweep over both lists."""
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e, _ in base):
        # spans of different kinds may overlap: their unions ascend in both ends
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out = []
    k = 0
    for m in TOKEN.finditer(text):
        value, (s, e) = m.group(), m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        mixed = any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)
        if mixed and entropy(value) >= LEAST_BITS:
            out.append(("token", s, e, value))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


_SPAN = "struct<kind:string,start:int,end:int,hash:binary,base:boolean>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("base", pa.bool_())]
    for part, texts in bounded_slices(batches):
        counts, digests, lists = [], [], []
        for text in texts:
            base = base_spans(text)
            more = added_candidates(text, base)
            counts.append([sum(kind == k for kind, *_ in base) for k in KINDS[:3]])
            digests.append(hashlib.sha256(written([x[:3] for x in base]).encode()).hexdigest())
            lists.append(
                [
                    dict(kind=k, start=s, end=e, hash=hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest(), base=i < len(base))
                    for i, (k, s, e, v) in enumerate([*base, *more])
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0), part.column(1), part.column(2), part.column(3),
                *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)],
                pa.array(digests), pa.array(lists, pa.list_(pa.struct(fields))),
            ],
            ["doc_id", "owner", "repository", "print", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def scan(
    docs: DataFrame,
    *,
    owner: Column | None = None,
    repository: Column | None = None,
    most_owners: int = MOST_OWNERS,
    most_texts: int = MOST_TEXTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_copied.

    ``owner`` and ``repository`` say whose a row is; a table of documents has no such
    columns, so its ``source`` stands for the owner and source with language for the
    repository unless given, and where one is not given a live value lies in ``most_texts``
    distinct texts at most.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    whose = named(F.col("source")) if owner is None else named(owner)
    place = F.concat_ws("/", named(F.col("source")), named(F.col("lang"))) if repository is None else named(repository)
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("print")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whose.alias("owner"), place.alias("repository"), mark, "text")
    schema = (
        "doc_id long, owner string, repository string, print long, n_assign long, n_access long, n_hex long, "
        f"base_sha256 string, found array<{_SPAN}>"
    )
    rows = materialise(own.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()), "scanned")
    held = materialise(
        rows.where(F.size("found") > 0).select("row", "owner", "repository", "print", F.explode("found").alias("s")).select(
            "row", "owner", "repository", "print", "s.*"
        ),
        "candidates",
    )
    # distinct holders fold before the shuffle, however often a value is copied
    holders = held.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = holders.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    verdicts = materialise(
        owners.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n")
        ),
        "ownership",
    )
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= 2 * most_owners)
    if owner is None or repository is None:
        texts = held.select("hash", "print").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_texts"))
        verdicts = materialise(verdicts.join(texts, "hash"), "texts")
        live = live & (F.col("n_texts") <= most_texts)
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    judged = skew_join(held, verdicts, "hash", "n", max(total, 1)).withColumn("live", live)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = F.array_sort(
        F.collect_list(F.when(F.col("base") | F.col("live"), F.struct("start", order.alias("order"), "kind", "end")))
    )
    spans = judged.groupBy("row").agg(
        F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"),
        F.sum((~F.col("base") & F.col("live")).cast("long")).alias("n_added"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
    )
    plain = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    none = rows.where(F.size("found") == 0).select(
        *plain, F.lit("").alias("spans"), *[F.lit(0).cast("long").alias(c) for c in ("n_added", "n_live", "n_copied")]
    )
    some = rows.where(F.size("found") > 0).select("row", *plain).join(spans, "row").drop("row")
    return none.unionByName(some)
