"""Exact dedup (11): a streaming query keeps a digest, an identifier and a locator for each text, in state on disk that never expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, new_path, written

#: The state store that keeps its keys on disk, with a bound on what its caches hold in memory for all partitions of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Groups of over this many rows, and of over this share of all rows, are joined by broadcast: there are at most 1 / SHARE of them.
HOT, SHARE = 200, 1e-5
#: Digests of repeated texts up to which they are broadcast to the scan that checks bytes; more of them are joined by shuffle.
BROADCAST_DIGESTS = 1_000_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _named(rows: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows (id, body, place, digest): null texts count as empty; a place is a file and a row of it."""
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return rows.select(F.col(key).cast("long").alias("id"), body.alias("body"), place.alias("place"), digest(body).alias("digest"))


def absorb(spark: SparkSession, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 2_000) -> None:
    """Takes the files of a Parquet table that are new since the checkpoint into its keyed state, and ends.

    The state has a row for each digest: how many rows came, and the greatest identifier with its locator. It
    lives in RocksDB, on disk, and is saved with each batch in the checkpoint, so that a lost executor or a
    stopped run goes on where the last batch ended; files already taken are not read again. It does not expire.
    Rows of one digest are added up before they are shuffled, so a task gets a row of each other task for a key.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        # a pattern, so that one file will do as well as a folder; files count as new whatever their age
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(f"{path[:-1]}[{path[-1]}]")
        seen = _named(stream, key, text, digest).groupBy("digest").agg(F.max(F.struct("id", "place")).alias("stays"), F.count("*").alias("rows"))
        seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows (digest, keep_id, place, rows) of the state as the last batch left it."""
    state = spark.read.format("statestore").load(checkpoint)
    stays, rows = state.schema["value"].dataType.names
    return state.select("key.digest", F.col(f"value.{stays}.id").alias("keep_id"), F.col(f"value.{stays}.place").alias("place"), F.col(f"value.{rows}").alias("rows"))


def checked(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (digest, body, keep_id, place, rows): the different texts behind each digest that more than one row has.

    Whole texts are compared, byte by byte, as keys of an aggregation: copies fall together in the task that
    reads them, and only texts of hits, one from each task, are shuffled. same tells whether a text is the one
    that the state's locator points to.
    """
    hits = hits.select(F.col("digest").alias("of"), F.col("place").alias("kept_at"))
    few = hits.count() <= BROADCAST_DIGESTS
    met = docs.join(F.broadcast(hits) if few else hits, F.col("digest") == F.col("of"))
    same = met.groupBy("digest", "body").agg(F.max(F.struct("id", "place")).alias("stays"), F.count("*").alias("rows"), F.max(F.col("place") == F.col("kept_at")).alias("same"))
    return same.select("digest", "body", F.col("stays.id").alias("keep_id"), F.col("stays.place").alias("place"), "rows", "same")


def dedup(spark: SparkSession, path: str, checkpoint: str | None = None, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of a Parquet table.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest
    identifier stays; of rows that repeat it, the one furthest on by file and row. Rows without an identifier
    stay only where no other has one. An empty table gives no rows; columns other than key and text don't
    matter. With a checkpoint of an earlier run only files that came since are taken into the state; what the
    state points to has to be there still.

    Digests only propose: texts of every digest met twice are compared whole with the one that the locator
    points to. Should two texts share a digest, their rows are grouped by the texts themselves instead.
    """
    checkpoint = checkpoint or new_path(spark, "seen")
    absorb(spark, path, checkpoint, key, text, digest)
    docs = _named(spark.read.parquet(path), key, text, digest)
    state = written(retained(spark, checkpoint), "seen-state")
    n = state.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hits = state.where("rows > 1")
    texts = written(checked(docs, hits).select("digest", "same"), "seen-texts")
    clash = texts.where("not same").select("digest").distinct()
    rows = written(docs.select("id", "digest", "place", sha256(F.col("body")).alias("sha")), "seen-rows")
    out = _members(rows, state, n)
    if not clash.isEmpty():  # texts that share a digest: by whole texts, for the rows of these digests alone
        clash = written(clash, "seen-clash")
        groups = written(checked(docs, hits.join(clash, "digest", "left_semi")), "seen-groups")
        own = docs.join(clash, "digest", "left_semi").alias("d").join(groups.alias("g"), (F.col("d.digest") == F.col("g.digest")) & (F.col("d.body") == F.col("g.body")))
        own = own.select("d.id", "g.keep_id", F.col("g.rows").alias("rows"), (F.col("d.place") == F.col("g.place")).alias("kept"), sha256(F.col("d.body")).alias("sha"))
        out = _members(rows.join(clash, "digest", "left_anti"), state.join(clash, "digest", "left_anti"), n).unionByName(own)
    drop(texts)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("rows").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _members(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """rows with what stays of their digest. The few groups with a large share of the rows are looked up where these are."""
    most = max(HOT, int(n * SHARE))
    state = state.select(F.col("digest").alias("of"), "keep_id", F.col("place").alias("kept_at"), "rows")
    hot, rest = state.where(F.col("rows") > most), state.where(F.col("rows") <= most)
    met = rows.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left")
    found = met.where("of is not null")
    other = met.where("of is null").select(*rows.columns).join(rest, F.col("digest") == F.col("of"))
    kept = (F.col("place") == F.col("kept_at")).alias("kept")
    return found.select("id", "keep_id", "rows", kept, "sha").unionByName(other.select("id", "keep_id", "rows", kept, "sha"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
