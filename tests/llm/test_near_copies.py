"""The pipeline's near-dedup stage against all pairs of shingle sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from siftwork.llm import common, near_copies

from .common import WORDS, documents, frame, prose


def plain_kept(rows):
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d for d in sets if root(d) == d}


def test_near_stage_has_all_pairs_from_0_8(spark, sf):
    rng, rows = random.Random(8), []
    base = [prose(200 + s, n) for s, n in enumerate([3, 6, 12, 30, 60, 90, 150])]
    for d in range(300):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        if rng.random() < 0.3:
            w = w[rng.randrange(3) :]
        rows.append((d * 7 % 300, " ".join(w)))
    kept = corpus_pipeline.near(spark, frame(spark, [(d, t, "en", "a", 1) for d, t in rows]), sf).collect()
    assert sorted(r.doc_id for r in kept) == sorted(plain_kept(rows))


def test_near_stage_edges(spark, sf):
    kept = corpus_pipeline.near(spark, frame(spark, clashes=True), sf).collect()
    want = plain_kept([(r[0], r[1]) for r in documents() if r[0] is not None])
    assert 11 not in want and sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert not any(r.doc_id is None for r in kept)  # their text is that of document 4
    assert corpus_pipeline.near(spark, frame(spark, []), sf).count() == 0


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_near_stage_judges_rows_by_their_texts(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(near_copies, "BROADCAST_GONE", limit)
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (1, prose(2, 50)), (None, prose(3, 50)), (None, prose(3, 50)), (None, prose(1, 50)), (2, prose(2, 50))]
    for df in (frame(spark, [(d, t, "en", "a", 1) for d, t in rows]), frame(spark, [(d, t, "en", "a", 1) for d, t in reversed(rows)])):
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, df, sf).collect()]
        assert sorted(kept, key=str) == sorted([(1, prose(1, 50)), (1, prose(2, 50)), (None, prose(3, 50))], key=str)


def test_near_stage_takes_the_pairs_of_simhash(spark, sf, monkeypatch):
    nodes = spark.createDataFrame([(10, 0b1011), (4, 0b1000), (7, 0b1011), (9, 1 << 40), (3, 0b1111 << 20)], "sig long, fp long")
    assert sorted(map(tuple, near_copies.fingerprint_pairs(nodes).collect())) == [(4, 7), (4, 9), (7, 10)]
    asked, pairs = [], near_copies.fingerprint_pairs
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda nodes: asked.append(1) or pairs(nodes))
    assert corpus_pipeline.near(spark, frame(spark, [(d, prose(4, 50), "en", "a", 1) for d in range(3)]), sf).count() == 1 and asked


def test_counts_are_handed_on_in_packed_rows(spark):
    texts = spark.createDataFrame([("a b a" * 200,), (None,), ("c",), ("",)], "text string").repartition(3)
    found = common.counts_of(texts, 12, lambda b, off: np.concatenate([b.astype(np.int32), np.full(len(b), 4095, np.int32)]))
    want = Counter(("a b a" * 200 + "c").encode())
    assert {k: int(n) for k, n in enumerate(found) if n} == want | {4095: want.total()} and len(found) == 4096
    packed = list(common._packed_counts(12, lambda b, off: b.astype(np.int32))(iter(texts.select("text").toArrow().to_batches())))
    assert sum(b.num_rows for b in packed) == 1
