"""What the operators of this subpackage share: the shared folder, written tables, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import Counts, pieces

#: Counts in a row of a task's packed table.
COUNTS_ROW = 1 << 10

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a local session names none, as in tests, a temporary folder of this process is used; on a
    cluster, whose executors do not see it, that is an error.
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


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later stages read it again, whatever executor is lost.

    What was shuffled for it is removed when it stands.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        place = None if table is None else vars(table).get("written_to")
        if place:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Arrow batches are limited by bytes, so that very long texts do not pile up in a Python worker.

    A smaller limit that the session has already, from its user or from an operator planned before, stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > mb << 20:
        spark.conf.set(name, str(mb << 20))


def tidy(run):
    """A function of Arrow batches that, when it ends, gives the memory it has freed back to the system.

    Python workers live on for later stages; what they only keep for themselves counts against the executor.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


def _packed_counts(bits: int, numbers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Counts(1 << bits)
        for batch in batches:
            for _, _, b, off in pieces(batch.column(0)):
                of.add(numbers(b, off))
        rows = of.result().reshape(-1, COUNTS_ROW)
        some = np.flatnonzero(rows.any(axis=1))
        width = [next(w for w in (1, 2, 4, 8) if most < 1 << min(8 * w, 63)) for most in rows[some].max(axis=1).tolist()]
        counts = [rows[k].astype(f"<u{w}").tobytes() for k, w in zip(some, width, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(width, pa.int32()), pa.array(counts, pa.binary())], names=["place", "width", "counts"])

    return run


def _added_counts(rows: pa.Table) -> pa.Table:
    total = np.zeros(COUNTS_ROW, np.int64)
    for width, counts in zip(rows.column("width").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        total += np.frombuffer(counts, f"<u{width}").astype(np.int64)
    return pa.table({"place": rows.column("place").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def counts_of(texts: DataFrame, bits: int, numbers) -> np.ndarray:
    """How often each number below 2**bits is among the numbers(bytes, offsets) of the texts: a table of fixed size.

    A task hands on its table in rows of many counts, each of as few bytes as hold them, not a row for a number.
    """
    packed = texts.mapInArrow(tidy(_packed_counts(bits, numbers)), "place int, width int, counts binary")
    table = packed.groupBy("place").applyInArrow(_added_counts, "place int, counts binary").toArrow()
    out = np.zeros((1 << bits) // COUNTS_ROW * COUNTS_ROW, np.int64).reshape(-1, COUNTS_ROW)
    for place, counts in zip(table["place"].to_pylist(), table["counts"].to_pylist(), strict=True):
        out[place] = np.frombuffer(counts, np.int64)
    return out.ravel()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Each round takes the smallest label among neighbours and then follows labels once (pointer jumping), so
    the number of rounds grows with the logarithm of the longest path. Every round is a written table.
    """
    both = written(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "edges",
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("at")).agg(F.min("component").alias("low"))
        low = labels.join(near, labels.node == near.at, "left").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        low = written(low, "labels")
        to = low.select(F.col("node").alias("from"), F.col("component").alias("next"))
        after = low.join(to, low.component == to["from"], "left").select("node", "was", F.least("component", "next").alias("component"))
        after = written(after, "labels")
        drop(labels, low)
        labels = after.select("node", "component")
        labels.written_to = vars(after)["written_to"]
        if after.where("was <> component").isEmpty():
            drop(both)
            return labels
