"""The order of a context and what fills it, against plain Python on graphs with cycles, ties and empty texts."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.operators import channel


def plain_levels(ids, edges):
    edges = {(a, b) for a, b in edges if a != b and a in ids and b in ids}
    into = {i: sum(b == i for _, b in edges) for i in ids}
    out, heads, level = dict.fromkeys(ids, 0), [i for i in ids if not into[i]], 0
    while heads:
        behind = []
        for h in heads:
            out[h] = level
            for a, b in edges:
                if a == h:
                    into[b] -= 1
                    if not into[b]:
                        behind.append(b)
        heads, level = behind, level + 1
    return out


def graphs(seed):
    """{group: (ids, edges)}: sparse and dense graphs, some with cycles, loops, repeated edges and edges to nowhere."""
    rng = random.Random(seed)
    out = {}
    for g in range(12):
        ids = list(range(rng.randint(1, 9)))
        edges = [(rng.choice([*ids, 99]), rng.choice(ids)) for _ in range(rng.randint(0, 14))]
        if g % 2:
            edges = [(min(e), max(e)) for e in edges]
        out[g] = (ids, edges)
    return out


def frames(spark, gs, rng):
    nodes = [(g, i, round(rng.random(), 3) if rng.random() < 0.7 else 0.5, rng.choice(["a/b/x.py", "src/types.ts", "package.json", "LICENSE"])) for g, (ids, _) in gs.items() for i in ids]
    edges = [(g, a, b) for g, (_, es) in gs.items() for a, b in es]
    return nodes, spark.createDataFrame(nodes, "g long, id long, relevance double, path string"), spark.createDataFrame(edges, "g long, src long, dst long")


def alpha(p, n):
    reach = max(1.0, 0.15 * n)
    return 1.0 if n <= 1 else round(0.4 * math.exp(-p / reach) + 0.4 * math.exp(-(n - 1 - p) / reach) + 0.2, 12)


def plain_order(ids, level, worth):
    top = max(level.values())
    leaf = {i for i in ids if level[i] == top > 0}
    return sorted((i for i in ids if i not in leaf), key=lambda i: (level[i], -worth[i], i)) + sorted(leaf, key=lambda i: (worth[i], -i))


def plain_slots(order, level, rel):
    n, out, at = len(order), {}, 0
    for lv in sorted(set(level.values())):
        own = [i for i in order if level[i] == lv]
        spots = list(range(at, at + len(own)))
        if len(own) > 2:
            own = sorted(own, key=lambda i: (-rel[i], order.index(i)))
            spots = sorted(spots, key=lambda p: (-alpha(p, n), p))
        out |= dict(zip(own, spots, strict=True))
        at += len(own)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_and_orders(spark, seed):
    gs, rng = graphs(seed), random.Random(seed)
    nodes, df, edges = frames(spark, gs, rng)
    levelled = df.join(channel.levels(df, edges, "g", "id"), ["g", "id"]).withColumn("importance", channel.importance(F.col("relevance"), F.col("path")))
    rows = channel.bookend(channel.interleave(levelled, "g", "id", "importance"), "g", "relevance").collect()
    boosts = {"a/b/x.py": 1.0, "src/types.ts": 1.5, "package.json": 2.0, "LICENSE": 3.0}
    assert len(rows) == len(nodes)
    for g, (ids, es) in gs.items():
        mine = {r.id: r for r in rows if r.g == g}
        level = plain_levels(ids, es)
        assert {i: r.level for i, r in mine.items()} == level
        rel = {i: r.relevance for i, r in mine.items()}
        order = plain_order(ids, level, {i: r.relevance * boosts[r.path] for i, r in mine.items()})
        assert sorted(ids, key=lambda i: mine[i].place) == order
        assert {i: r.slot for i, r in mine.items()} == plain_slots(order, level, rel)


def test_attention(spark):
    rows = spark.range(20).select("id", F.round(channel.attention(F.col("id"), F.lit(20)), 12).alias("a")).collect()
    assert all(abs(r.a - alpha(r.id, 20)) < 1e-9 for r in rows)
    assert spark.range(1).select(channel.attention(F.col("id"), F.lit(1)).alias("a")).first().a == 1.0


def plain_fill(rows, room):
    out, left = [], room
    for k, t in rows:
        if 0 < t <= left:
            out.append(k)
            left -= t
    return out


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_fill(spark, chunk):
    """First fit, with rows passed over, rows without tokens, groups without room, and any size of chunk."""
    rng = random.Random(7)
    rows = {g: [(k, rng.choice([0, 1, 3, 7, 20, 50])) for k in range(rng.randint(0, 25))] for g in range(15)}
    room = {g: rng.choice([0, 5, 40, 100]) for g in rows}
    df = spark.createDataFrame([(g, k, t) for g, x in rows.items() for k, t in x], "g long, k long, tokens long")
    rooms = spark.createDataFrame(list(room.items()), "g long, room long")
    got = defaultdict(list)
    for r in channel.fill(df, rooms, "g", "k", [F.asc("k")], chunk=chunk).orderBy("g", "place").collect():
        got[r.g].append(r.k)
    assert {g: got[g] for g in rows} == {g: plain_fill(x, room[g]) for g, x in rows.items()}


def test_trailing_pass(spark):
    """Gains and picks by sets of byte trigrams; short, empty and null texts; no room, no rows."""
    rng = random.Random(3)
    text = lambda: rng.choice(["", "ab", "é", None]) if rng.random() < 0.2 else " ".join(rng.choice(["alpha", "beta", "gämma", "delta", "rho"]) for _ in range(rng.randint(1, 9)))
    rows = [(g, k, text(), rng.randint(1, 12), round(rng.random(), 3), rng.random() < 0.3) for g in range(6) for k in range(12)]
    chosen = [(g, k) for g, k, *_ in rows if k % 4 == 0]
    room = {0: 0, 1: 10, 2: 25, 3: 60, 4: 1, 5: 30}
    df = spark.createDataFrame(rows, "g long, k long, text string, tokens long, entropy double, defines boolean")
    args = (df, spark.createDataFrame(chosen, "g long, k long"), spark.createDataFrame(list(room.items()), "g long, room long"), "g", "k")
    got = defaultdict(list)
    for r in channel.trailing_pass(*args).orderBy("g", "place").collect():
        got[r.g].append(r.k)
    grams = lambda t: [b[i : i + 3] for b in [(t or "").encode()] for i in range(len(b) - 2)]
    for g, left in room.items():
        mine = [r for r in rows if r[0] == g]
        old = {x for r in mine if (g, r[1]) in chosen for x in grams(r[2])}
        scored = []
        for _, k, t, tokens, entropy, defines in mine:
            if (g, k) not in chosen and tokens <= left:
                x = grams(t)
                novelty = 1.0 - (sum(y in old for y in x) / len(x) if x else 0.0)
                scored.append((-round(entropy * novelty * (1.5 if defines else 1.0) / tokens, 12), k, tokens))
        assert got[g] == plain_fill([(k, t) for _, k, t in sorted(scored)], left)
