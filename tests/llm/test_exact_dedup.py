"""Exact dedup by streaming state, against plain groups of texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm import exact_dedup

from .common import frame


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256), and how many rows each text keeps (one)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for t, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out


def key(x):
    return tuple((v is None, v) for v in x)


def same(found, rows):
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    for sha in {r.text_sha256 for r in found}:
        kept = [r for r in found if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_fixture(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names that the operator uses."""
    df = frame(spark, clashes=True).withColumns({c: F.lit(1) for c in ("digest", "place", "id", "rows", "keep_id", "stays", "of")})
    df.repartition(5, "text").write.parquet(f"{tmp_path}/t.parquet")
    same(exact_dedup.dedup(spark, f"{tmp_path}/t.parquet").collect(), rows_of(df))


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/t.parquet")
    assert exact_dedup.dedup(spark, f"{tmp_path}/t.parquet").collect() == []


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_texts_that_share_a_digest(spark, tmp_path, monkeypatch, broadcast):
    """With digests of four values nearly all texts collide, and whole texts tell them apart."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", broadcast)
    df = frame(spark)
    df.write.parquet(f"{tmp_path}/t.parquet")
    weak = lambda t: F.pmod(F.xxhash64(t), F.lit(4))
    same(exact_dedup.dedup(spark, f"{tmp_path}/t.parquet", digest=weak).collect(), rows_of(df))


def test_hot_group(spark, tmp_path):
    """A third of all rows are copies of one text, over the bound for groups that are broadcast."""
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 4))).alias("text"))
    df.repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    same(exact_dedup.dedup(spark, f"{tmp_path}/t.parquet").collect(), rows_of(df))


def test_growing_table(spark, tmp_path):
    """State goes on from its checkpoint: only new files are taken, and the result is that of the whole table."""
    path, at = f"{tmp_path}/t.parquet", f"file://{tmp_path}/seen"
    parts = [[(1, "a"), (2, "b"), (3, "a")], [(9, "b"), (4, "c"), (0, None)], [(5, ""), (7, "a")]]
    taken = []
    for part in parts:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        taken += part
        same(exact_dedup.dedup(spark, path, at).collect(), taken)
    exact_dedup.absorb(spark, path, at)  # nothing is new
    state = exact_dedup.retained(spark, at).collect()
    assert sum(r.rows for r in state) == len(taken) and len(state) == 4
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")  # settings are as before


def test_matches_sql(spark, sf):
    import duckdb

    want = duckdb.sql(exact_dedup.SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    found = [tuple(r) for r in exact_dedup.query(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(found) == sorted(want)
