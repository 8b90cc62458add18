"""Quality rules (5): surface rules, then the hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, tidy
from ..functions.scan import _LEAD, _SPACE, Counts, hashes, lines, mix, per_document, pieces, windows, words

#: log2 of the number of hashed n-grams; the tables of counts have this fixed size at any scale.
BITS = 18
#: Trusted documents up to which their ids are broadcast; more are joined by shuffle. Both count all of them.
BROADCAST_DOCS = 1_000_000
#: Mean log-likelihood ratio per n-gram, in nats, from which a document is kept.
THRESHOLD = -0.25
#: Counts of the flat prior beside each bucket's target count.
PRIOR = 4.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIR = np.uint64(0xA24BAED4963EE407)


def ngrams(b: np.ndarray, off: np.ndarray, starts: np.ndarray, h: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams as (buckets, offsets by document): words, pairs of words, and 4 bytes in a row.

    A word followed by itself counts as one and the same pair for every word.
    """
    top = np.uint64(64 - bits)
    at = np.searchsorted(starts, off)
    pairs = np.where(h[:-1] == h[1:], _PAIR, mix(h[:-1] * _PAIR + h[1:])) if len(h) > 1 else h[:0]
    inside = np.ones(len(pairs), bool)
    inside[(at[1:-1] - 1)[(at[1:-1] > 0) & (at[1:-1] < len(h))]] = False
    sums = np.concatenate([[0], np.cumsum(inside)])
    out = [((h >> top).astype(np.int64), at), ((pairs[inside] >> top).astype(np.int64), sums[np.minimum(at, len(pairs))])]
    wide = b.astype(np.uint32)
    n = max(0, len(b) - 3)
    code = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3 : n + 3] << np.uint32(24)
    inside = np.ones(n, bool)
    for back in (1, 2, 3):
        cut = off[1:] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    sums = np.concatenate([[0], np.cumsum(inside)])
    out.append(((code[inside] * np.uint32(2654435761) >> np.uint32(32 - bits)).astype(np.int64), sums[np.minimum(off, n)]))
    return out


def _count_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_all, of_target = Counts(1 << bits), Counts(1 << bits)
        for batch in batches:
            trusted = np.asarray(batch.column(1).fill_null(False))
            for i, j, b, off in pieces(batch.column(0)):
                starts, ends = words(b, off)
                for buckets, at in ngrams(b, off, starts, hashes(b, starts, ends), bits):
                    of_all.add(buckets)
                    if trusted[i:j].any():
                        of_target.add(buckets[np.repeat(trusted[i:j], np.diff(at))])
        raw, target = of_all.result(), of_target.result()
        some = np.flatnonzero(raw)
        for k in range(0, len(some), 1 << 16):
            s = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(raw[s]), pa.array(target[s])], names=["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket.

    raw counts every n-gram of every document, target those of all trusted ones (column doc_id). Both multinomials are smoothed by the same flat
    prior, worth PRIOR counts a bucket beside the target's counts and as much more beside the raw ones as
    there are more of these, so that rare n-grams tell little however small the target is. Only the table
    of 2**bits counts reaches the driver.
    """
    bounded_batches(docs.sparkSession)
    some = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    few = some.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    marked = docs.select("doc_id", "text").join(F.broadcast(some) if few else some, "doc_id", "left").select("text", "trusted")
    counts = marked.mapInArrow(tidy(_count_batches(bits)), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    table = counts.toArrow()
    at = np.asarray(table["bucket"])
    raw[at], target[at] = np.asarray(table["raw"]), np.asarray(table["target"])
    return ratios_of(raw, target)


def ratios_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The smoothed log ratios; all 0 if the target has no n-grams."""
    share = target.sum() / max(1.0, raw.sum())
    return np.log((target + PRIOR) / (raw * share + PRIOR)).astype(np.float32)


def measures(b: np.ndarray, off: np.ndarray, ratios: np.ndarray, bits: int = BITS) -> dict[str, np.ndarray]:
    """The measures of each document of a chunk."""
    n = len(off) - 1
    starts, ends = words(b, off)
    h = hashes(b, starts, ends)
    at = np.searchsorted(starts, off)
    n_words = np.diff(at)
    owner = np.repeat(np.arange(n), n_words)
    total, grams = np.zeros(n), np.zeros(n, np.int64)
    for buckets, cut in ngrams(b, off, starts, h, bits):
        sums = np.concatenate([[0.0], np.cumsum(ratios[buckets], dtype=np.float64)])
        total += sums[cut[1:]] - sums[cut[:-1]]
        grams += np.diff(cut)
    repeated = np.zeros(n, np.int64)
    if len(h) >= WINDOW:
        first = np.flatnonzero(owner[: len(h) - WINDOW + 1] == owner[WINDOW - 1 :])
        key = mix(windows(h, WINDOW)[first] ^ mix(owner[first].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, first[twice], 1)
        np.add.at(step, first[twice] + WINDOW, -1)
        repeated = np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=n)
    l_starts, l_ends, l_doc = lines(b, off)
    filled = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    l_doc = l_doc[filled]
    l_key = mix(hashes(b, l_starts[filled], l_ends[filled]) ^ mix(l_doc.astype(np.uint64)))
    _, once = np.unique(l_key, return_index=True)
    return {
        "n_words": n_words,
        "word_chars": per_document(_LEAD[b] & ~_SPACE[b], off),
        "n_symbols": per_document(_SYMBOL[b], off),
        "n_dup_lines": np.bincount(l_doc, minlength=n) - np.bincount(l_doc[once], minlength=n),
        "n_repeat_words": repeated,
        "llr": total / np.maximum(1, grams),
    }


def _measure_batches(shared, bits: int):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [measures(b, off, ratios, bits) for _, _, b, off in pieces(batch.column(at))]
            new = [pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.float64() if k == "llr" else pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return run


def scored(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    A document fails the base rules with fewer than 20 words or with over 30 % of its words in 8-word windows
    found twice or more. The others are kept if the mean log-likelihood ratio of their hashed n-grams reaches
    the threshold. Null and empty texts have no words and fail. Without trusted documents every ratio is 0. Columns of docs with these names are replaced; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*new, "llr", "base_failed", "kept")
    ratios = log_ratios(docs, trusted, bits)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, T.LongType()) for k in new], T.StructField("llr", T.DoubleType())])
    out = docs.mapInArrow(tidy(_measure_batches(spark.sparkContext.broadcast(ratios), bits)), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """The documents that labels marks as of good quality."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, trusted_ids(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
