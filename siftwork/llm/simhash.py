"""SimHash near-duplicates (4): fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, written
from ..functions.scan import pieces, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SEED = 42


def fingerprints(b: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint for each document: the majority bit of the XXH64 of its word shingles.

    Texts of fewer words than a shingle have the whole sequence as one; texts without words have 0.
    """
    starts, ends = words(b, off)
    lower = _LOWER[b]
    counts = np.searchsorted(starts, off[1:]) - np.searchsorted(starts, off[:-1])
    # words joined by one space each: word k of the chunk is flat[at[k] : at[k] + size[k]]
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else size
    total = int((size + 1).sum())
    flat = np.full(total, 32, np.uint8)
    step = np.ones(int(size.sum()), np.int64)
    if len(size):
        jump = np.cumsum(size)[:-1]
        source, target = step.copy(), step
        source[0], target[0] = starts[0], at[0]
        source[jump] = starts[1:] - ends[:-1] + 1
        target[jump] = 2
        flat[np.cumsum(target)] = lower[np.cumsum(source)]
    n_shingles = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
    first_word = np.cumsum(counts) - counts
    begin = np.repeat(first_word, n_shingles) + np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    final = np.minimum(begin + width - 1, np.repeat(first_word + counts - 1, n_shingles))
    view, hash64 = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((hash64(view[s:e], SEED) for s, e in zip(at[begin].tolist(), (at[final] + size[final]).tolist(), strict=True)), np.uint64, len(begin)) if len(begin) else np.zeros(0, np.uint64)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(n_shingles)
    if len(full):
        edges = (np.cumsum(n_shingles) - n_shingles)[full]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        major = (2 * votes > n_shingles[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, j, b, off in pieces(batch.column(1)):
                out[i:j] = fingerprints(b, off, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return run


def document_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint's bit pattern as a signed long. Null texts count as empty."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(width), f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


#: Fingerprints that a key of the join should have, on average at most, and segments of the ring at most.
PER_KEY, MOST_SEGMENTS = 16, 32


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, bits) of m segments of 64 bits."""
    sizes = [64 // m + (k < 64 % m) for k in range(m)]
    return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(parts: list[tuple[int, int]], start: int, length: int) -> int:
    """The mask of `length` consecutive segments of the ring from `start` on."""
    return sum(((1 << n) - 1) << at for at, n in (parts[(start + k) % len(parts)] for k in range(length)))


def ring(n: int, distance: int) -> tuple[int, int]:
    """(segments, segments that must be equal) for n fingerprints.

    A chain of l segments may have l * distance / segments differences, so the longest chain that may have
    none is the join's key. With more segments it has more bits: 21 of 64 for distance 2 and three segments,
    24 for eight, 30 for 32. The ring is the first of these whose keys have few fingerprints on average.
    """
    m = distance + 1
    while True:
        equal = -(-m // distance) - 1 if distance else m
        bits = min(bin(_chain(_segments(m), s, equal)).count("1") for s in range(m))
        if n <= PER_KEY << bits or 2 * m > MOST_SEGMENTS:
            return m, equal
        m = 8 if m < 8 else 2 * m


def links(prints: DataFrame, distance: int = 2, hot: int = 2000, segments: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), so that their components are those of all pairs within the distance.

    Pigeonring: the 64 bits form a ring of segments. If two fingerprints differ in at most `distance` bits, a
    segment exists from which every chain of l consecutive segments has at most l * distance / segments
    differences. The first segments of the chain, as far as that allows none, must hence be equal, which is
    the join's key; longer chains are checked before the full distance. There are as many segments as keep
    the keys narrow at the number of fingerprints (`ring`), unless they are given.

    What is left above `hot` fingerprints in a key are groups of near copies, and these give no pairs. There,
    for distance 2, two fingerprints are linked through what both reach by flipping at most one bit outside
    the key (which holds for exactly those within distance 2), each to the smallest one that reaches it: the
    work stays linear, and the components are the same. For other distances pairs are joined in every key.
    """
    m, equal = ring(prints.count(), distance)
    if segments:
        m, equal = segments, (-(-segments // distance) - 1 if distance else segments)
    parts = _segments(m)
    masks = [_signed(_chain(parts, start, equal)) for start in range(m)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in masks])).alias("segment", "value"))
    keyed = written(keyed, "segments")
    sizes = keyed.groupBy("segment", "value").agg(F.count("*").alias("n"))
    if distance == 2:
        warm = sizes.where(F.col("n").between(2, hot)).select("segment", "value")
        cold = keyed.join(warm, ["segment", "value"], "left_semi")
    else:
        cold = keyed
    a, b = cold.alias("a"), cold.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    chains = F.lit(True)
    for start in range(m):
        held = F.lit(True)
        for length in range(equal + 1, m):
            held = held & (F.bit_count(differ.bitwiseAND(F.lit(_signed(_chain(parts, start, length))))) <= length * distance // m)
        chains = chains & (held | (F.col("a.segment") != start))
    pairs = a.join(b, (F.col("a.segment") == F.col("b.segment")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= distance) & chains)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if distance != 2:
        return pairs.distinct()
    crowded = keyed.join(sizes.where(F.col("n") > hot).select("segment", "value"), ["segment", "value"], "left_semi")
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    outside = F.filter(flips, lambda x: F.bit_count(x.bitwiseXOR(F.col("fp")).bitwiseAND(F.col("mask"))) == 0)
    reached = crowded.withColumn("mask", F.element_at(F.array(*[F.lit(x) for x in masks]), F.col("segment") + 1))
    reached = reached.select("fp", F.explode(F.concat(F.array("fp"), outside)).alias("middle"))
    lowest = reached.groupBy("middle").agg(F.min("fp").alias("a"))
    stars = reached.join(lowest, "middle").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Null or empty texts and texts of white space alone have fingerprint 0 and are linked like any other.
    Repeated rows keep their number and share a component; an empty table gives an empty result; a
    component whose doc_ids are all null has a null component_id. Other columns of docs are not read.
    """
    prints = written(document_fingerprints(docs, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "nodes")
    edges = written(links(nodes.select("fp"), distance), "links")
    if edges.isEmpty():
        return prints.join(nodes.withColumnRenamed("lowest", "component_id"), "fp").select("doc_id", "fp", "component_id")
    found = components(edges)
    joined = nodes.join(found, nodes.fp == found.node, "left").select("fp", "lowest", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, width=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
