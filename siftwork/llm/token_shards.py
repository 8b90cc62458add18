"""Token-ID output (2): the corpus as one stream of token ids, cut into sequences that a keyed permutation puts in training order.

Sequence k of the stream goes to slot permute(k): a Feistel network with cycle-walking is a bijection of the
sequences, so the order needs no sort and no stored list, and can be inverted. Each range of slots is a shard,
a file of records of one size: a reader finds any slot by its place, and can go on from where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, written
from ..functions.scan import mix

#: Token ids in a sequence, sequences in a shard, the id after each document, and rounds of the network.
LENGTH, SHARD, END, ROUNDS, KEY = 2048, 4096, 50256, 6, 20240229
#: Token ids in a row of the first table, and documents whose counts of ids set how rows are packed.
BLOCK, PACK_DOCS = 1 << 17, 100
#: Beginnings of stretches (a file's rows read by one task) up to which they are broadcast.
BROADCAST_STRETCHES = 500_000


def _keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))


def _half_bits(n: int) -> int:
    return max(1, (max(2, n) - 1).bit_length() + 1 >> 1)


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    if back:
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
    else:
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
    return left << h | right


def permute(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A bijection of 0 ... n - 1, or its inverse. Values outside are walked on until they fall inside.

    The network's domain is under four times n, so a value is walked four times on average at most.
    """
    half, keys = _half_bits(n), _keys(key)
    out = _network(np.asarray(x, np.uint64), half, keys, back)
    while (outside := out >= n).any():
        out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """The ranks of a .tiktoken file (by default the public byte-level vocabulary) and its pattern for words."""
    import base64

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def _tiktoken(vocabulary: tuple[dict[bytes, int], str]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={}).encode_ordinary


def _packing(docs: DataFrame, ranks) -> np.ndarray:
    """All 16-bit ids, the most frequent of some documents first: as places in this order they pack better.

    Which documents are counted changes the size of the tables between the steps, and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = _tiktoken(ranks), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(encode(text or ""), minlength=1 << 16)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["id", "n"])

    table = docs.select("text").limit(PACK_DOCS).mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 16, np.int64)
    counts[np.asarray(table["id"])] = np.asarray(table["n"])
    return np.argsort(-counts, kind="stable").astype("<u2")


def _planes(x: np.ndarray) -> bytes:
    """High and low bytes apart, which pack better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 2).T.tobytes()


def _joined(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _tokenizer(shared, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, order = shared.value
        encode, places = _tiktoken(ranks), np.argsort(order).astype("<u2")
        pack = zstandard.ZstdCompressor(level=3)
        names = ["file", "row", "place", "size", "ids"]
        # a stretch is a run of consecutive rows of a file that this task reads
        file, first, following, place, ids, size = None, 0, None, 0, [], 0

        def flush():
            flat = places[np.concatenate(ids)]
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first], pa.int64()), pa.array([place], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([pack.compress(_planes(flat))], pa.binary())], names=names)

        for batch in batches:
            for name, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (name, row) != (file, following):
                    if ids:
                        yield flush()
                    file, first, place, ids, size = name, row, 0, [], 0
                ids.append(np.array([*encode(text or ""), end], np.int32))
                size += len(ids[-1])
                following = row + 1
                if size >= block:
                    yield flush()
                    place, ids, size = place + size, [], 0
        if ids:
            yield flush()

    return run


def _cutter(total: int, length: int, key: int, shard: int):
    n = -(-total // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start, size, ids in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                flat = _joined(unpack.decompress(ids))
                sequence = np.arange(start // length, (start + size - 1) // length + 1)
                low, high = np.maximum(sequence * length, start), np.minimum((sequence + 1) * length, start + size)
                slot = permute(sequence, n, key)
                parts = [pack.compress(_planes(flat[a - start : b - start])) for a, b in zip(low, high, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(slot // shard), pa.array(slot), pa.array((low - sequence * length).astype(np.int32)), pa.array(parts, pa.binary())], names=["shard", "slot", "at", "ids"])

    return run


def _shard_writer(shared, folder: str, length: int, shard: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        unpack, order = zstandard.ZstdDecompressor(), shared.value[1]
        out, name, now, slots, held = None, "", None, 0, []

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([name]), pa.array([slots], pa.int64())], names=["shard", "file", "slots"])

        def put():
            record = np.full(length, end, "<u2")
            for at, ids in held:
                record[at : at + len(ids)] = ids
            out.write(record.tobytes())

        slot = None
        for batch in batches:
            for s, where, at, ids in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if where != slot and held:
                    put()
                    held, slots = [], slots + 1
                if s != now:
                    if out:
                        yield close()
                    now, name, slots = s, f"shard-{s:08d}-{uuid.uuid4().hex}.bin", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                slot = where
                held.append((at, order[_joined(unpack.decompress(ids))]))
        if held:
            put()
            slots += 1
        if out:
            yield close()

    return run


def _located(docs: DataFrame) -> DataFrame:
    """(file, row, text): where each row stands; for rows that come from no file, the partition and the place in it."""
    try:
        return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "text")
    except AnalysisException:
        return docs.select(F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("file"), F.monotonically_increasing_id().alias("row"), "text")


def materialise(docs: DataFrame, folder: str | None = None, length: int = LENGTH, shard: int = SHARD, key: int = KEY, end: int = END, ranks=None) -> tuple[DataFrame, str, int]:
    """Writes the shards: their manifest (shard, file, slots) as a table, the folder, and the number of token ids.

    The stream is the documents in the order of files and rows, each followed by the id `end`; it does not
    depend on how many tasks read them. The last sequence is filled up with `end`. Null and empty texts give
    an `end` alone, repeated rows repeat, other columns are not read, and an empty table gives no shard. Ids
    must fit 16 bits.

    Texts are tokenised once, into a table of packed blocks. Where a task's stretch of the stream begins is the
    sum of the sizes before it: of its file, and of the files before, a row for each of which goes through one
    task. The beginnings are broadcast where they are few, else joined. One shuffle then takes every sequence
    to the task of its range of slots.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 4)
    folder = folder or new_path(spark, "shards")
    ranks = ranks or vocabulary()
    shared = spark.sparkContext.broadcast((ranks, _packing(docs, ranks)))
    blocks = written(_located(docs).mapInArrow(_tokenizer(shared, end, BLOCK), "file string, row bigint, place bigint, size bigint, ids binary"), "blocks")
    stretches = written(blocks.groupBy("file", "row").agg(F.sum("size").alias("size")), "stretches")
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_files = stretches.groupBy("file").agg(F.sum("size").alias("size")).withColumn("base", before(Window.orderBy("file"))).drop("size")
    begins = stretches.withColumn("begin", before(Window.partitionBy("file").orderBy("row"))).join(of_files, "file").select("file", "row", (F.col("base") + F.col("begin")).alias("begin"))
    begins = written(begins, "begins")
    total, n_stretches = stretches.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    placed = blocks.join(F.broadcast(begins) if n_stretches <= BROADCAST_STRETCHES else begins, ["file", "row"])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    cut = placed.select(F.col("begin") + F.col("place"), "size", "ids").mapInArrow(_cutter(total, length, key, shard), "shard bigint, slot bigint, at int, ids binary")
    n_shards = max(1, -(-total // (length * shard)))
    ranged = cut.repartition(min(n_shards, 20_000), "shard").sortWithinPartitions("slot", "at")
    manifest = written(ranged.mapInArrow(_shard_writer(shared, folder, length, shard, end), "shard bigint, file string, slots bigint"), "manifest")
    return manifest, folder, total


def read(manifest: DataFrame, folder: str, start: int = 0, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Rows (slot, ids) from a slot on: a resumed reader goes straight to the first record it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for s, name, slots in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                first = max(start, s * shard)
                with files.open_input_file(f"{root}/{name}") as f:
                    f.seek((first - s * shard) * 2 * length)
                    for at in range(first, s * shard + slots, 256):
                        n = min(256, s * shard + slots - at)
                        ids = np.frombuffer(f.read(n * 2 * length), "<u2").astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * length, length, dtype=np.int32)), pa.array(ids))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], names=["slot", "ids"])

    wanted = manifest.select("shard", "file", "slots").where((F.col("shard") + 1) * shard > start)
    # one task a shard: the rows are few, the files behind them large
    return wanted.repartition(max(1, min(wanted.count(), 20_000)), "shard").mapInArrow(run, "slot bigint, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest, folder, total = materialise(docs)
    n = -(-total // LENGTH)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(sequence=permute(pdf["slot"].to_numpy(), n, back=True))

    rows = read(manifest, folder).select("slot", F.xxhash64("ids").alias("ids_hash"))
    placed = rows.mapInPandas(place, "slot long, ids_hash long, sequence long")
    used = F.least(F.lit(LENGTH), F.lit(total) - F.col("sequence") * LENGTH)
    return placed.select("slot", "sequence", F.floor(F.col("slot") / SHARD).cast("long").alias("shard"), (F.col("slot") % SHARD * 2 * LENGTH).alias("offset"), used.cast("long").alias("n_ids"), "ids_hash")
