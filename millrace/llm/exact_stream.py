"""Exact duplicates by stateful streaming, checked on the full bytes.

A row is reduced to a digest of its normalised text. The digests flow as a stream
through keyed state on disk (RocksDB, no expiry) which keeps, per digest, the
stable identifier and the locator of the first row and the number of rows. The
state lives in the checkpoint folder, so a lost executor restores it from there.
Digests seen twice are hits; the texts behind hits are read again and grouped by
all their bytes, so two texts with one digest would be told apart.

Defined results: a null text counts as empty; null ids sort last, so a group keeps
a row without an id only if no row has one (``keep_id`` is then null); of rows with
equal text and equal id exactly one is kept; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, empty_like, mark_maybe, materialise, scratch_path, skew_join

SCHEMA = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _digests(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    hashed = norm.withColumn("sha", F.unhex(F.sha2(F.col("norm"), 256)))
    return hashed.withColumn("key", key(F.col("sha")))


def _file_of(docs: DataFrame) -> Column:
    """The file a row comes from; empty for frames with several sources."""
    try:
        docs.select(F.input_file_name())
    except AnalysisException:
        return F.lit("")
    return F.input_file_name()


def _first() -> Column:
    """The row that stays: smallest id, rows without an id last, then the locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))


def update_state(stream: DataFrame, checkpoint: str) -> None:
    """Let a stream of ``(key, doc_id, file, row)`` run through the keyed state once.

    Running it again with the same checkpoint goes on where it ended: rows that
    arrived since are added to the state, none is ever dropped from it.
    """
    seen = stream.groupBy("key").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
    run = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()


def read_state(spark, checkpoint: str) -> DataFrame:
    """The keyed state as a table: key, first, n."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.key", F.col("value.*")).toDF("key", "first", "n")


def deduplicate(
    docs: DataFrame,
    *,
    key: Callable[[Column], Column] = lambda sha: sha,
    bytes_per_batch: int = 1 << 38,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row.

    ``key`` maps the SHA-256 of a text to the key of the state; a weaker key only
    makes hits that the full bytes refute. ``row`` numbers the rows of this result's
    group members uniquely.
    """
    spark = docs.sparkSession
    located = _digests(docs, key).select(
        "doc_id", "sha", "key", _file_of(docs).alias("file"), F.monotonically_increasing_id().alias("row")
    )
    folder = scratch_path(spark, "digests")
    located.write.parquet(folder)
    rows = spark.read.schema(located.schema).parquet(folder)
    total = rows.count()
    if not total:
        return empty_like(spark, SCHEMA + ", row bigint")

    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # the run ends with its input: a store's local files go as soon as its batch is committed
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint = scratch_path(spark, "state")
    stream = session.readStream.schema(rows.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(folder)
    update_state(stream, checkpoint)
    state = materialise(read_state(spark, checkpoint), "seen")

    # Full bytes of every possible hit, equal texts folded before the shuffle.
    texts = mark_maybe(_digests(docs, key), state.where("n > 1").select("key"), ["key"], "hit").where("hit")
    groups = texts.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"))
    clashes = materialise(groups.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "clashes")

    clean = rows
    clashed = None
    if clashes.take(1):
        clean = rows.join(clashes.select("key"), "key", "left_anti")
        own = _digests(docs, key).join(clashes.select("key"), "key", "left_semi")
        own = materialise(
            own.select("doc_id", "sha", "norm", F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")),
            "clashed",
        )
        by_text = own.groupBy("norm").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
        clashed = skew_join(own, by_text, "norm", "n", total)
        clashed = clashed.withColumn("row", -1 - F.col("row")).withColumn(
            "first", F.col("first").withField("row", -1 - F.col("first.row"))
        )
    found = skew_join(clean, state, "key", "n", total)
    columns = [
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    ]
    out = found.select(*columns)
    return out if clashed is None else out.unionByName(clashed.select(*columns))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` marked ``kept`` in ``decided`` (doc_id, text_sha256, kept), all columns.

    A row is known by its id and the digest of its text; of rows equal in both one
    stays, so rows without an id do too. Only rows that may have been dropped are
    shuffled: a bitmap over the dropped ones lets the others pass where they are.
    Equal rows fold where they are read, before any shuffle.
    """

    def known(sha: Column) -> Column:
        return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), sha)

    tags = decided.select(known(F.col("text_sha256")).alias("__mr_row"), "kept")
    stays = tags.where("kept").groupBy("__mr_row").agg(F.count(F.lit(1)).alias("n"))
    dropped = tags.where(~F.col("kept")).select("__mr_row").unionByName(stays.where("n > 1").select("__mr_row"))
    dropped = materialise(dropped, "dropped")
    own = docs.withColumn("__mr_row", known(F.sha2(normalised(F.col("text")), 256)))
    marked = mark_maybe(own, dropped, ["__mr_row"], "__mr_maybe")
    sure = marked.where(~F.col("__mr_maybe")).drop("__mr_maybe")
    # one exchange serves folding and join
    looked_at = marked.where("__mr_maybe").drop("__mr_maybe").dropDuplicates(["__mr_row"])
    looked_at = looked_at.join(stays.select("__mr_row"), "__mr_row", "left_semi")
    return sure.unionByName(looked_at).drop("__mr_row")
