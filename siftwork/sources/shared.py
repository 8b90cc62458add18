"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where a local session names none, as in tests, a temporary folder of this process; on a cluster, whose
    executors do not see such a folder, an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="siftwork-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def plain_unions(spark: SparkSession) -> None:
    """From now on the session's unions promise nothing about where keys are.

    Spark 4.1 takes a union of tables that are shuffled by one key to be shuffled by it. Adaptive execution may
    coalesce them unlike each other, and an aggregation behind the union then leaves rows of one key apart.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches are limited by bytes, so that very long texts do not pile up in a Python worker.

    A smaller limit that the session has already, from its user or from an operator planned before, stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > mb << 20:
        spark.conf.set(name, str(mb << 20))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df, label: str):
    """df as a Parquet table of its own in the shared folder, read again: lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def joins_in_place(spark: SparkSession):
    """What is planned meanwhile joins tables that are shuffled by some of a join's keys where they are. The setting before comes back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def bucketed(df: DataFrame, label: str, group: str, placed: bool = False) -> DataFrame:
    """df as a table in the shared folder, bucketed by group, read again: windows, sums and joins by group shuffle no more.

    There are as many buckets as the session's shuffles have partitions. placed tells that df's rows are in the
    partitions of such a table already, where Spark cannot know it (behind a Python function). The table's name is
    its own, and its files stay in the folder.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with joins_in_place(spark):
        (df if placed else df.repartition(n, group)).write.bucketBy(n, group).option("path", path).saveAsTable(name)
    return spark.table(name)
