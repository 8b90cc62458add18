"""Line dedup, token shards, WARC, nearest neighbours, mixing and the pipeline against plain Python."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import ann, line_dedup, mixing, pieces, quality_rules, token_shards, warc

from .common import WORDS, documents, frame, prose
from .test_near_copies import plain_kept


def plain_removed(rows):
    """Every line with an earlier one of Jaccard similarity 0.8 or more, by all pairs."""
    lines = [(d, i, frozenset(WORDS.findall(x))) for d, t in sorted(rows) for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(d, i) for k, (d, i, w) in enumerate(lines) if any(9 * len(w & v) >= 4 * (len(w) + len(v)) for _, _, v in lines[:k])}


def near_lines(n=160):
    rng, rows = random.Random(4), []
    shared = [prose(s, k) for s, k in enumerate([3, 4, 5, 6, 9, 12, 25, 40])]
    for d in range(n):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(shared).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
            if rng.random() < 0.3:
                rng.shuffle(words)
            lines.append(" ".join(words))
        rows.append((d * 7 % n, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("first", "few", "wide"), [(1, 0, 40), (1, 20_000, 3), (1024, 20_000, 5)])
def test_line_dedup(spark, monkeypatch, first, few, wide):
    """With few candidates at first, lines stay open, which a scan settles, or a second join where they are many."""
    monkeypatch.setattr(line_dedup, "FIRST", first)
    monkeypatch.setattr(line_dedup, "OPEN_LINES", few)
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    monkeypatch.setattr(line_dedup, "PARTNERS", 1 if wide == 3 else 2_000)
    rows = near_lines()
    want = plain_removed(rows)
    assert want
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, line string").repartition(5)
    found = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for d, t in rows:
        stay = [x for i, x in enumerate(t.split("\n")) if (d, i) not in want]
        assert (found[d].text, found[d].n_removed) == ("\n".join(stay), len(t.split("\n")) - len(stay))


def test_known_lines():
    """A line counts as met only where an equal one of an earlier place was posted."""
    known = line_dedup._Known()
    one = lambda *rows: [np.array(c, k) for c, k in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64, np.int64), strict=True)]
    meet = lambda *rows: known.earlier(*one(*rows), np.ones(len(rows), bool)).tolist()
    assert meet((5, 9, 0, 1), (6, 1, 0, 0), (7, 2, 0, 0)) == [False] * 3
    assert meet((5, 8, 0, 0), (6, 3, 0, 0)) == [False] * 2
    known.settle()
    assert meet((5, 8, 0, 0), (5, 8, 0, 1), (5, 7, 5, 5), (6, 2, 0, 0), (7, 3, 0, 0)) == [False, True, False, True, False]
    known.settle()
    assert meet((5, 8, 0, 0), (5, 7, 5, 5), (6, 1, 0, 0), (7, 9, 0, 0)) == [True, False, False, False]


def test_line_dedup_edges(spark):
    found = line_dedup.dedup_lines(frame(spark, clashes=True)).collect()
    assert len(found) == len(documents())
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[12][0].text is None and by[13][0].text == "" and by[14][0].text == " \t\n "
    assert by[10][0].text == "" and by[11][0].text == ""
    assert [r.n_removed for r in by[3]] == [0, 0]  # the same row twice is one document
    assert by[17][0].text == "\nshort line" and by[17][0].n_removed == 3
    assert all(r.text == "" for r in by[None])  # they come after document 4
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_permutation():
    for n in (1, 2, 3, 16, 17, 1000):
        slots = token_shards.permute(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
        assert (token_shards.permute(slots, n, back=True) == np.arange(n)).all()
    assert (token_shards.permute(np.arange(1000), 1000, key=1) != token_shards.permute(np.arange(1000), 1000, key=2)).any()


def test_token_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    manifest, folder, total = token_shards.materialise(docs, length=128, shard=100)
    n = -(-total // 128)
    ids = {r.slot: r.ids for r in token_shards.read(manifest, folder, length=128, shard=100).collect()}
    assert sorted(ids) == list(range(n))
    stream = [x for slot in token_shards.permute(np.arange(n), n) for x in ids[slot]]
    encode = token_shards._tiktoken(token_shards.vocabulary())
    want = [x for r in docs.select("text").collect() for x in [*encode(r.text), token_shards.END]]
    assert stream[:total] == want and set(stream[total:]) <= {token_shards.END}
    resumed = token_shards.read(manifest, folder, start=333, length=128, shard=100)
    assert sorted(r.slot for r in resumed.collect()) == list(range(333, n))


def test_token_shards_edges(spark):
    manifest, folder, total = token_shards.materialise(frame(spark, clashes=True))
    assert token_shards.read(manifest, folder).count() == -(-total // token_shards.LENGTH)
    manifest, folder, total = token_shards.materialise(frame(spark, []))
    assert total == 0 and token_shards.read(manifest, folder).count() == 0


def test_warc(spark):
    rows = [
        (1, "http://a.b/x", "abc"), (2, "http://a.b/x", "abc"), (2, "http://a.b/x", "abc"), (3, None, None), (4, "http://c.d", ""),
        (None, "http://e", "abc"), (7, "http://ü.x/é?q=1", "é" * 100_000), (8, "http://ü.x/é?q=1", "new"), (9, "nonsense\r\n://[", "odd\r\n\r\n"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    found = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.captures(pages).collect())
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        lead = first[html or ""]
        want.append((page or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == lead else "revisit", -1 if page == lead else lead))
    assert found == sorted(want)
    assert warc.captures(pages.limit(0)).count() == 0


def test_warc_index(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example.org/{k % 50}", f"page {k}") for k in range(500)], "page_id long, url string, html string")
    archives, folder = warc.new_path(spark, "archives"), warc.new_path(spark, "cdx")
    top = warc.write_index(warc.write_archives(pages, archives), folder, block_lines=7)
    key = warc.surt("http://h3.example.org/10")
    assert key == "org,example,h3)/10"
    wanted = spark.createDataFrame([(key, 0, 10**9), ("org,example,h9)/", 0, 10**9)], "key string, low long, high long")
    hits = warc.read_records(warc.search(top, folder, wanted), archives, payloads=True).collect()
    assert sorted(r.page_id for r in hits) == [k for k in range(500) if k % 7 == 3 and k % 50 == 10]
    assert all(r.payload == f"page {r.page_id}".encode() for r in hits)


def test_nearest_recall(spark, sf):
    rows = ann.query(spark, sf).collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    hits = total = 0
    for q in (k for k in vectors if k % 20 == 0):
        best = sorted((-float((vectors[q] * v).sum()), k) for k, v in vectors.items() if k != q)[:20]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - float((vectors[q] * vectors[r.vec_id]).sum())) < 1e-12 for r in mine)
        hits += len({k for _, k in best} & {r.vec_id for r in mine})
        total += 20
    assert hits >= 0.9 * total


def test_nearest_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=5) * (1 + k % 3)], "x") for k in range(30)]
    rows += [(40, rows[0][1], "x"), (41, rows[0][1], "x"), (41, rows[0][1], "x"), (42, None, "x"), (43, [0.0] * 5, "x"), (44, [1.0, None, 0.0, 0.0, 0.0], "x"), (45, [float("nan")] * 5, "x"), (46, [float("inf")] * 5, "x"), (47, [1.0], "x"), (None, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string")
    for block in (3, 4000):
        found = ann.nearest(df, F.col("id") % 20 == 0, k=50, tables=8, probes=16, block=block).collect()
        good = {k: np.array(v) for k, v, _ in rows[:33]}
        for q in (0, 20, 40):
            want = sorted((-float((good[q] * v).sum()), k) for k, v in good.items() if k != q)
            assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [k for _, k in want]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_mixing(spark):
    rows = [(k, prose(k, 30), "en", "abc"[0 if k < 700 else 1 if k < 950 else 2], 1) for k in range(1000)] + [(k, None, "en", None, 0) for k in range(1000, 1010)]
    docs = frame(spark, rows, clashes=True)
    rates = {r.source: r.rate for r in mixing.rates(docs).collect()}
    assert rates[None] == 1.0 and rates["a"] < rates["b"] < rates["c"]
    mixed = mixing.mix(docs)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, n in (("a", 700), ("b", 250), ("c", 50)):
        assert abs(counts[source] - n * rates[source]) < 5 * math.sqrt(n * rates[source])
    assert mixing.mix(docs.repartition(7)).select("doc_id", "copy").exceptAll(mixed.select("doc_id", "copy")).isEmpty()
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    given = {r.source: r.rate for r in mixing.rates(docs, weights).collect()}
    assert given["c"] == 0.0 and given["b"] > given["a"]
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_joins_many_sources_alike(spark, monkeypatch):
    docs = frame(spark)
    want = sorted(map(str, mixing.mix(docs).select("doc_id", "source", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).select("doc_id", "source", "copy").collect())) == want


def test_mixing_edges(spark):
    docs = frame(spark, [(None, prose(k, 20), "en", "a", 1) for k in range(400)] + [(None, "same", "en", "b", 1)] * 3)
    mixed = mixing.mix(docs)
    assert 300 < mixed.where("source = 'a'").count() < 500  # drawn one by one
    assert mixed.where("source = 'b'").count() % 3 == 0
    named = [("a", 1.0), ("a", 1.0), ("b", -5.0), (None, 3.0)]
    found = {r.source: r.rate for r in mixing.rates(docs, spark.createDataFrame(named, "source string, weight double")).collect()}
    assert len(found) == 2 and found["b"] == 0.0 and found["a"] > 0
    assert mixing.mix(docs, spark.createDataFrame([("a", 0.0)], "source string, weight double")).count() == 0
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def plain_copies(rows):
    """How often each (doc_id, source, text) is drawn, by plain sums of Poisson probabilities."""
    size, out = {}, []
    for _, source, text in rows:
        size[source] = size.get(source, 0) + len(text or "")
    weight = {s: n**mixing.ALPHA for s, n in size.items()}
    for d, source, text in rows:
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source] if size[source] else 1.0
        parts = max(1, math.ceil(rate / mixing.PART))
        for j in range(parts):
            u = int(hashlib.md5(f"{mixing.SEED}:{d}:{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p, c = math.exp(-rate / parts), math.exp(-rate / parts)
            k = 0
            while c <= u:
                k += 1
                p *= rate / parts / k
                c += p
            out += [(d, source, text)] * k
    return out


def test_pipeline_against_plain_stages(spark, sf, tmp_path):
    """All five stages on a small corpus, against plain Python from the quality verdicts on."""
    rng, rows = random.Random(5), []
    shared = prose(900, 30)
    for d in range(40):
        text = [prose(1000 + 5 * d + j, rng.randint(25, 60)) for j in range(rng.randint(1, 3))]
        if d % 3 == 0:
            text.append(shared)
        rows.append((d, "\n".join(text), "en", "ab"[d % 5 == 0], 1))
    for d in range(40, 50):
        words = rows[d - 40][1].split(" ")
        words[len(words) // 2] = f"new{d}"
        rows.append((d, " ".join(words), "en", "a", 1))
    rows += [(60, None, "en", "a", 0), (61, "too short", "en", "a", 0), (62, "la la la la " * 30, "en", "b", 1)]
    frame(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    judged = quality_rules.scored(frame(spark, rows), quality_rules.trusted_ids(spark, str(tmp_path))).collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert 60 not in kept and 61 not in kept and 62 not in kept and len(kept) > 40
    docs = [(d, t, s) for d, t, _, s, _ in rows if d in kept]
    gone = plain_removed([(d, t) for d, t, _ in docs])
    assert gone
    docs = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone), s) for d, t, s in docs]
    stay = plain_kept([(d, t) for d, t, _ in docs])
    assert len(stay) < len(docs)
    encode = pieces.Encoder(pieces.load())
    want = sorted((d, s, np.frombuffer(encode.encode(t), np.int32).tolist()) for d, s, t in plain_copies([(d, s, t) for d, t, s in docs if d in stay]))
    found = sorted((r.doc_id, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == want and len(want) > 20


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf), "test")
        assert after.columns == docs.columns, name
        before = after
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == before.count() > 0
    for tiny in (frame(spark, clashes=True).withColumn("n_removed", F.lit("mine")), frame(spark, [])):
        columns = tiny.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            tiny = stage(spark, tiny, sf)
            assert tiny.columns == columns, name
        if "kept" in columns:
            assert {(r.kept, r.copy, r.n_removed, r.shuffle_key) for r in tiny.collect()} == {("x", "x", "mine", "x")}
        corpus_pipeline.encoded(spark, tiny, sf).collect()
