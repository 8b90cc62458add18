"""Ranked lexical search against a plain reading of its formula."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import lexical
from siftwork.llm.common import written

from .common import frame, prose

TERM = re.compile(lexical.TERM)
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=10):
    """[(item_id, score, doc_id)] by the formula, over (doc_id, text) and (item_id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i] += Counter(terms(t))
    out = {}
    for item, q in asked.items():
        scores = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out[item] = [(-s, i) for s, _, i in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def ranked(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r.item_id].append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return dict(out)


ITEMS = [(1, prose(0, 60)), (2, "ONE two words Ünïcode"), (3, "a b c mi ro ta ta ta"), (4, None), (5, ""), (6, "never-met-before"), (None, "short line"), (2, "tasel ro"), (7, prose(99, 500))]


@pytest.mark.parametrize("shard,window,block", [(8 << 20, 8192, 200_000), (1, 1, 200_000), (700, 3, 4)])
def test_fixture(spark, monkeypatch, shard, window, block):
    """Nulls, empty and long texts, ties, repeated rows; the same in one shard and in one of each document, with blocks of questions."""
    for name, v in (("SHARD_BYTES", shard), ("WINDOW", window), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical, name, v)
    df = frame(spark, clashes=True).withColumns({c: F.lit(1) for c in ("term", "shard", "body")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"term": F.lit("x"), "doc_id": F.lit(9)})
    index = written(lexical.build(df.repartition(3)), "index")
    assert index.where("term is null").select("shard").distinct().count() > (8 if shard < 1000 else 0)
    assert ranked(lexical.search(index, items).collect()) == plain([tuple(r) for r in df.select("doc_id", "text").collect()], ITEMS)


def test_ties_go_to_the_smallest(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (99, "other"), (98, "things")] * 1
    index = written(lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), "index")
    got = ranked(lexical.search(index, spark.createDataFrame([(1, "words WORDS")], "item_id long, text string"), k=41).collect())
    assert got == plain(docs, [(1, "words words")], 41) and [d for _, d in got[1]] == [*range(1, 41), None]


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = written(lexical.build(frame(spark, [])), "index")
    assert lexical.search(none, items).collect() == []
    some = written(lexical.build(frame(spark)), "index")
    assert lexical.search(some, items.limit(0)).collect() == []


def test_terms_that_share_a_hash(monkeypatch):
    """Where hashes collide, lengths and bytes tell terms apart."""
    monkeypatch.setattr(lexical.scan, "hashes", lambda b, s, e: ((e - s) % 2).astype(np.uint64))
    docs = [(i, prose(i, 40)) for i in range(6)]
    rows = lexical.shard_rows("x", pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.large_string())).to_pylist()[1:]
    want = Counter(t for _, x in docs for t in set(terms(x)))
    assert {r["term"]: r["df"] for r in rows} == want and len(rows) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=40))
def test_packed_numbers(values):
    data, ends = lexical.packed(np.array(values, np.int64))
    assert lexical.unpacked(data.tobytes()).tolist() == values and (not values or ends[-1] == len(data))


def test_matches_sql(spark, sf):
    import duckdb

    sql = lexical.SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'").replace("FROM benchmark", f"FROM '{sf}/benchmark.parquet'")
    assert sorted(map(tuple, lexical.query(spark, sf).collect())) == sorted(duckdb.sql(sql).fetchall())
