"""Nearest neighbours of few vectors, and of vectors of unlike norms, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import ann


def recall(spark, x):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found: dict[int, list[int]] = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits, total = 0, 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.argsort(-s)[: min(20, len(x) - 1)]
        assert len(set(found[q])) == len(found[q]) == len(want)
        hits += len(set(want.tolist()) & set(found[q]))
        total += len(want)
    return hits / total


@pytest.mark.parametrize("n", [2, 16, 40, 60, 100, 200, 500])
def test_few_vectors(spark, sf, n):
    x = np.stack([np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(n).collect()])
    assert recall(spark, x) == 1.0


@pytest.mark.parametrize("n,kind", [(2000, "even"), (6000, "even"), (6000, "clusters")])
def test_more_vectors(spark, n, kind):
    """Vectors with and without near neighbours, enough of them that buckets decide what is met."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)) + (4 * rng.normal(size=(40, 64))[rng.integers(0, 40, n)] if kind == "clusters" else 0)
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.93


@pytest.mark.parametrize("long", [4.0, 100.0])
def test_a_long_vector_does_not_collapse_the_others(spark, sf, long):
    x = np.stack([np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    x[7] *= long
    assert recall(spark, x) >= 0.9
