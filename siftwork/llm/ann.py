"""Approximate nearest neighbours (9): cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tables, axes probed by a query in each table, and the most vectors or queries of a bucket in one task.
TABLES, PROBES, BLOCK = 16, 10, 4000
SEED = 5
#: Rows of the buckets that a query probes, repeats included, for each of the k it asks for: with fewer it is ranked against all.
MET = 100


def _signs(dim: int, tables: int, seed: int) -> np.ndarray:
    """Random signs for three rounds of each table's pseudo-rotation."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """x through three rounds of random signs and a Hadamard transform, padded with zeros to a power of two."""
    out = np.zeros((len(x), signs.shape[1]))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: k for +e_k, k + dim for -e_k."""
    both = np.concatenate([y, -y], axis=1)
    top = np.argpartition(-both, min(probes, both.shape[1] - 1), axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)


def _assign(lengths: dict[int, float], dim: int, tables: int, probes: int, seed: int):
    """Index rows: each vector's bucket in every table of its norm range. Query rows, marked: the buckets probed, in any range."""
    width = 1 << max(1, int(dim).bit_length())  # room for one more coordinate
    signs = _signs(width, tables, seed)

    def run(frames):
        for pdf in frames:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, dim))
            norm = np.linalg.norm(x, axis=1)
            length = np.maximum([lengths[k] for k in pdf["span"]], np.finfo(float).tiny)
            index = np.concatenate([x / length[:, None], np.sqrt(np.maximum(0.0, 1.0 - (norm / length) ** 2))[:, None]], axis=1)
            asked = np.flatnonzero(pdf["asked"].to_numpy(bool))
            unit = np.concatenate([x[asked] / norm[asked][:, None], np.zeros((len(asked), 1))], axis=1)
            for t in range(tables):
                home = axes(rotated(index, signs[t]), 1)[:, 0]
                yield pd.DataFrame({"bucket": t * 2 * width + home, "span": pdf["span"], "id": pdf["id"], "v": pdf["v"], "query": False})
                if len(asked):
                    near = axes(rotated(unit, signs[t]), probes)
                    rows = np.repeat(asked, near.shape[1])
                    yield pd.DataFrame({"bucket": t * 2 * width + near.ravel(), "span": 0, "id": pdf["id"].to_numpy()[rows], "v": pdf["v"].to_numpy()[rows], "query": True})

    return run


def _rank(k: int):
    def run(_key, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if len(queries) and len(index):
            q, x = np.stack(queries["v"].to_numpy()).astype(np.float64), np.stack(index["v"].to_numpy()).astype(np.float64)
            qid, vid = queries["id"].to_numpy(), index["id"].to_numpy()
            for at in range(0, len(q), 32):
                s = q[at : at + 32] @ x.T
                s[qid[at : at + 32][:, None] == vid] = -np.inf
                # every candidate that may be among the k best, whatever the rounding of the product; then the
                # sums in one order for all, so that equal vectors tie and the smaller id goes first
                slack = 1e-13 * x.shape[1] * np.linalg.norm(q[at : at + 32], axis=1) * np.linalg.norm(x, axis=1).max()
                least = np.partition(s, -k, axis=1)[:, -k] - slack if s.shape[1] > k else np.full(len(s), -np.finfo(float).max)
                row, col = np.nonzero(s >= least[:, None])
                exact = (q[at + row] * x[col]).sum(axis=1)
                order = np.lexsort((vid[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                out["query_id"].append(qid[at + row[best]])
                out["vec_id"].append(vid[col[best]])
                out["score"].append(exact[best])
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    return run


def valid_vectors(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """Rows (id, v) whose vector has the dimension, finite components only, and is not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim) & fine & F.exists("v", lambda x: x != 0))


def _best(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, best): the k best of x for each of q, within buckets and spans cut into q_cuts by x_cuts blocks."""
    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    q = q.withColumn("q_block", F.pmod(salt, F.col("q_cuts"))).withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("x_cuts") - 1)))
    x = x.withColumn("x_block", F.pmod(salt, F.col("x_cuts"))).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_cuts") - 1)))
    by = ["bucket", "span", "q_block", "x_block"]
    found = q.select(*by, "id", "v").groupBy(*by).cogroup(x.select(*[F.col(c).alias(c) for c in (*by, "id", "v")]).groupBy(*by)).applyInPandas(_rank(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))


def nearest(vectors: DataFrame, asked, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = SEED, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each asked vector the k nearest by inner product, but itself.

    asked is a condition on the column id. Inner products become angles by one more coordinate (vectors are
    divided by the greatest norm of their range and filled up to norm 1). Norms in a range differ by a factor
    of at most the root of 2, and each range has buckets of its own, so long vectors do not turn all others
    to the axis of the added coordinate. A table rotates all by random signs and fast
    Hadamard transforms and files each vector under its nearest signed axis; a query probes its nearest axes.
    Buckets are cut into blocks of about `block` rows by a hash of the id, on both sides, so no bucket has to
    fit a task; each block ranks its candidates exactly, on the vectors as they are, and the best of all
    blocks stay. A query whose probed buckets have fewer than MET * k rows in all is held against all rows
    instead, in such blocks too, and gets k, or all there are: recall is low only where few candidates are met,
    which is so for every query of a small table and for vectors far from others in a large one. Results are
    approximate only in which candidates are met.

    Null vectors, those with null or non-finite components, of zero length or of another dimension than the
    most frequent one take no part, nor do rows without an id. Ties go to the smaller id. Rows repeated with
    one id count once. An empty table gives an empty result.
    """
    dims = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = dims["dim"]
    rows = valid_vectors(vectors, id_col, vector, dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # ranges of half an octave, 1 in the middle of one; squares that leave the numbers' range go to the outermost
    rows = rows.withColumn("norm", norm).withColumn("span", F.greatest(F.lit(-9999), F.least(F.lit(9999), F.floor(2 * F.log2("norm") + 0.5))).cast("int"))
    lengths = {r["span"]: r["norm"] for r in rows.groupBy("span").agg(F.max("norm").alias("norm")).collect()}
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.drop("norm").withColumn("asked", asked)
    kind = dict(rows.dtypes)["v"]
    filed = rows.mapInPandas(_assign(lengths, dim, tables, probes, seed), f"bucket int, span int, id long, v {kind}, query boolean")
    filed = written(filed, "buckets")
    # at most tables * 4 * dim buckets a range of norms, whatever the number of vectors
    asking = filed.where("query").groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("q_cuts"))
    cuts = filed.where("not query").groupBy("bucket", "span").agg(F.count("*").alias("rows")).withColumn("x_cuts", F.ceil(F.col("rows") / block).cast("int")).join(asking, "bucket")
    cuts = written(cuts, "cuts")
    probed = filed.where("query").select("bucket", "id").join(F.broadcast(cuts.groupBy("bucket").agg(F.sum("rows").alias("rows"))), "bucket")
    many = written(probed.groupBy("id").agg(F.sum("rows").alias("met")).where(F.col("met") >= MET * k).select("id"), "many")
    q = filed.where("query").drop("span").join(many, "id", "left_semi").join(F.broadcast(cuts), "bucket")
    x = filed.where("not query").join(F.broadcast(cuts), ["bucket", "span"])
    best = written(_best(q, x, k), "nearest")
    ids = rows.where("asked").select(F.col("id").alias("query_id")).distinct()
    short = written(ids.join(best.where(F.size("best") >= k).select("query_id"), "query_id", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        q_cuts, x_cuts = -(-n_short // block), -(-rows.count() // block)
        every = rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("span"), "id", "v", F.lit(q_cuts).alias("q_cuts"), F.lit(x_cuts).alias("x_cuts"))
        filled = _best(every.join(short, every.id == short.query_id, "left_semi"), every, k)
        best = best.where(F.size("best") >= k).unionByName(filled)
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
