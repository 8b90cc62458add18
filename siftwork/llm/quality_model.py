"""Quality classifier (7): averaged vectors of hashed word and character n-grams under a softmax, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .quality_rules import ngrams
from ..functions.scan import hashes, pieces, words

BITS, DIM, EPOCHS, RATE, BATCH, SEED = 17, 8, 6, 4.0, 32, 11
#: Steps of descent at least: small sets of labels are gone over more often.
LEAST_STEPS = 500
#: Labelled documents to learn from, at most: those of the smallest hashes of doc_id. Bounds the training task.
TRAIN_DOCS = 4000
#: The rows with this remainder of crc32(doc_id) by 4 are held out.
HELD_OUT = 2
THRESHOLD = 0.7


class Model(NamedTuple):
    vectors: np.ndarray  # of each hashed n-gram
    weights: np.ndarray  # of each class
    bias: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to the log-odds of class 1 (before averaging), and the bias."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def features(b: np.ndarray, off: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The buckets of each document's n-grams, repeats included."""
    starts, ends = words(b, off)
    groups = ngrams(b, off, starts, hashes(b, starts, ends), bits)
    return [np.concatenate([x[at[k] : at[k + 1]] for x, at in groups]) for k in range(len(off) - 1)]


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Learns from (buckets, shares) of each document by stochastic gradient descent over shuffled minibatches.

    Both classes weigh alike. The rate falls linearly to zero, as is usual for such models.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    weights, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    labels = labels.astype(np.int64)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    worth = (0.5 / np.maximum(share, 1e-9)).astype(np.float32)
    batches = -(-len(docs) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    done, steps = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            sizes = [len(docs[i][0]) for i in some]
            ids, w = np.concatenate([docs[i][0] for i in some]), np.concatenate([docs[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            hidden = np.zeros((len(some), dim), np.float32)
            np.add.at(hidden, owner, vectors[ids] * w[:, None])
            z = hidden @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= worth[labels[some]][:, None] / len(some)
            step = rate * (1 - done / steps)
            back = p @ weights
            weights -= step * (p.T @ hidden)
            bias -= 0.1 * step * p.sum(axis=0)
            np.add.at(vectors, ids, (-step * len(some)) * back[owner] * w[:, None])
            done += 1
    return Model(vectors, weights, bias)


def _trainer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            for _, _, b, off in pieces(batch.column(0)):
                for x in features(b, off, bits):
                    ids, counts = np.unique(x, return_counts=True)
                    docs.append((ids.astype(np.int32), (counts / max(1, len(x))).astype(np.float32)))
        if docs:
            m = fit(docs, np.array(labels), bits)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in m], names=list(Model._fields))

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model learnt from labels (doc_id, label 0 or 1) in one task, over at most `train_docs` documents.

    None without labelled documents. Only the model reaches the driver, a table of fixed size.
    """
    bounded_batches(docs.sparkSession)
    some = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # of texts that share an id the one of the smallest hash, so that the model is the same in every run
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
    rows = picked.repartition(1).sortWithinPartitions("doc_id").select("text", "label").mapInArrow(_trainer(bits), "vectors binary, weights binary, bias binary").collect()
    if not rows:
        return None
    vectors, weights, bias = (np.frombuffer(x, np.float32) for x in rows[0])
    return Model(vectors.reshape(1 << bits, -1), weights.reshape(2, -1), bias)


def _score_batches(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, b, off in pieces(batch.column(batch.schema.get_field_index("text"))):
                starts, ends = words(b, off)
                total, n = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
                for buckets, at in ngrams(b, off, starts, hashes(b, starts, ends), bits):
                    sums = np.concatenate([[0.0], np.cumsum(margins[buckets], dtype=np.float64)])
                    total += sums[at[1:]] - sums[at[:-1]]
                    n += np.diff(at)
                scores.append(1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model | None, bits: int = BITS) -> DataFrame:
    """docs with the column score: the probability of label 1, from the whole text and nothing else.

    Null and empty texts have no n-grams and take what the bias gives; without a model every score is 0.5.
    Repeated rows score alike; an empty table gives an empty result; a column named score is replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score")
    margins = model.margins() if model else (np.zeros(1 << bits, np.float32), 0.0)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(margins), bits), schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
