"""Watching a feed: a file stream of rows whose batches are upserted into an index, and what depends on rows that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Columns of the index besides the key and what describes it: when a row was seen, whether it is a deletion, and where it is kept.
VERSION, GONE, BATCH, BUCKET = "_version", "_gone", "_batch", "_bucket"


class Watch:
    """An index of the newest row of each key of a feed, kept below a folder.

    feed is a folder (or file) of Parquet files; a file that comes later may repeat keys of earlier ones, and its
    rows take their place. deleted is a condition on the feed's rows that takes a key out. columns describe a
    row of the feed and are evaluated once for it, when it comes.

    Below folder, changes has every row of every batch, by batch and bucket; index has the newest row of each
    key, by bucket; checkpoint is the stream's. A batch writes its changes, then makes the buckets that it
    touched anew from all their changes. Both writes replace partitions whole, and a batch that is run again
    after a failure has the same files, so either is the same however often it runs.

    Of rows with one key in one batch the one of the newest file counts, then the last by file name and row. A
    null key is a key of its own. Deleted keys stay in the index as marks, so that a bucket never runs empty.
    """

    def __init__(self, spark: SparkSession, feed: str, folder: str, columns: dict[str, Column], key: str = "doc_id", deleted: str = "false", buckets: int = 16, schema: StructType | str | None = None):
        self.spark, self.feed, self.folder = spark, feed, folder.rstrip("/")
        self.columns, self.key, self.deleted, self.buckets = columns, key, deleted, buckets
        self.schema = schema or spark.read.parquet(feed).schema
        self.kept = self._described(spark.read.schema(self.schema).parquet(feed)).schema

    def _described(self, rows: DataFrame) -> DataFrame:
        m = F.col("_metadata")
        version = F.struct(m["file_modification_time"].alias("at"), m["file_path"].alias("file"), m["row_index"].alias("row"))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return rows.select(F.col(self.key), *[c.alias(n) for n, c in self.columns.items()], version.alias(VERSION), F.expr(self.deleted).alias(GONE), bucket.alias(BUCKET))

    def start(self, files_per_batch: int = 1000, every: str | None = None) -> StreamingQuery:
        """The stream: over what there is, or going on and looking again after every so long."""
        # a pattern, so that one file will do as well as a folder; files are new whatever their age
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(f"{self.feed[:-1]}[{self.feed[-1]}]")
        writer = self._described(source).writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def _take(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        replace = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        replace(rows.withColumn(BATCH, F.lit(batch).cast("long")), BATCH, BUCKET).parquet(f"{self.folder}/changes")
        changes = self.changes(spark)
        touched = [r[0] for r in changes.where(F.col(BATCH) == batch).select(BUCKET).distinct().collect()]  # numbers of buckets
        if touched:
            newest = self._newest(changes.where(F.col(BUCKET).isin(touched) & (F.col(BATCH) <= batch)))
            replace(newest.repartition(max(1, len(touched)), BUCKET), BUCKET).parquet(f"{self.folder}/index")

    def _newest(self, changes: DataFrame) -> DataFrame:
        rest = [c for c in changes.columns if c not in (self.key, BUCKET)]
        last = changes.groupBy(self.key, BUCKET).agg(F.max_by(F.struct(*rest), F.struct(BATCH, VERSION)).alias("_last"))
        return last.select(self.key, *[F.col(f"_last.{c}") for c in rest], BUCKET)

    def follow(self, files_per_batch: int = 1000) -> dict:
        """Takes what is new into the index and ends: {"batches", "rows"} that were taken."""
        query = self.start(files_per_batch)
        query.awaitTermination()
        taken = [p for p in query.recentProgress if p["numInputRows"]]
        return {"batches": len(taken), "rows": sum(p["numInputRows"] for p in taken)}

    def changes(self, spark: SparkSession | None = None) -> DataFrame:
        """Every row that came, with its batch."""
        return self._read(spark or self.spark, "changes")

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        schema = StructType([f for f in self.kept.fields if f.name != BUCKET]).add(BATCH, "long").add(BUCKET, "integer")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):  # nothing has come yet
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def index(self, marks: bool = False) -> DataFrame:
        """The newest row of each key; with marks also of those that are deleted, and the columns of housekeeping."""
        rows = self._read(self.spark, "index")
        return rows if marks else rows.where(~F.coalesce(GONE, F.lit(False))).select(self.key, *self.columns)

    def snapshot(self, batch: int) -> DataFrame:
        """The index as it stood after a batch."""
        rows = self._newest(self.changes().where(F.col(BATCH) <= batch))
        return rows.where(~F.coalesce(GONE, F.lit(False))).select(self.key, *self.columns)


def standing(dependents: DataFrame, index: DataFrame, key: str, seen: str, now: str) -> DataFrame:
    """dependents with standing: fresh where the row they were made of still has the digest they saw, else stale, or orphaned where it is gone.

    An equi-join on the key; index has one row a key. Null digests are equal to each other.
    """
    at = index.select(F.col(key).alias("_key"), F.col(now).alias("_now"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "orphaned").when(F.col(seen).eqNullSafe(F.col("_now")), "fresh").otherwise("stale")
    return dependents.join(at, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("standing", state).drop("_key", "_now", "_there")


def scan(spark: SparkSession, path: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files below path as (path, modified, bytes), and rows (path, change) against a scan known before: added, changed or deleted.

    Only the listing is read, no file's content. For projects whose files are edited in place, which a file
    stream, whose files never change, does not see.
    """
    from ..sources.files import snapshot_diff

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    now = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    mark = F.concat_ws("/", F.col("modified").cast("double"), "bytes")
    was = now.limit(0) if known is None else known
    return now, snapshot_diff(was.withColumn("hash", mark), now.withColumn("hash", mark))
