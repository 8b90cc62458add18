"""Families of questions as a stream with state, against a fold over all outcomes: in batches, over a restart, and forgotten by a timer."""

import random
import time

import pytest

from siftwork.streaming import crystals

SCHEMA = "team long, at long, question string, fragments string, reward double, baseline double"


def outcomes(seed, n=260):
    rng, rows = random.Random(seed), []
    kinds = [("how do we rotate the auth token", "auth.py,token.py", 0.95), ("why is the cache slow on reads", "cache.py", 0.3), ("where are retries configured", "retry.py,http.py,conf.py", 0.6)]
    for k in range(n):
        q, f, mean = rng.choice(kinds)
        if rng.random() < 0.3:
            q += rng.choice([" please", " again", " today", " in production"])
        if rng.random() < 0.1:
            q, f = rng.choice([("", "x.py"), ("zz", ""), (None, None), ("entirely other question number", "y.py")])
        rows.append((rng.randrange(3), k, q, f, min(1.2, max(-0.2, rng.gauss(mean, 0.05))), 0.4))
    return rows


def fold(rows):
    states, out = {}, []
    for team, at, q, f, reward, baseline in sorted(rows, key=lambda r: (r[0], r[1])):
        event = states.setdefault(team, crystals.Families({})).observe(q, f, reward, baseline, at)
        if event:
            out.append((team, *event.values()))
    return sorted(out)


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in crystals.STATE}
    for k, v in crystals.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run(spark, folder, idle_ms=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    events = crystals.crystallize(stream, "team", "at", idle_ms)
    events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_stream_is_the_fold_over_batches_and_a_restart(rocks, tmp_path):
    rows = outcomes(1)
    for part in (rows[:50], rows[50:51], rows[51:140]):
        put(rocks, tmp_path, part)
    assert run(rocks, tmp_path) == fold(rows[:140])
    put(rocks, tmp_path, rows[140:])  # another query goes on from the checkpoint
    got = run(rocks, tmp_path)
    assert got == fold(rows) and len({r[:2] for r in got}) >= 3
    assert all(r[8] is not None and r[5] > r[6] - 1 and r[7] >= crystals.GAIN for r in got)


def test_silent_keys_are_forgotten(rocks, tmp_path):
    """The timer fires with the first batch after the wait, and what comes then begins anew."""
    rows = [(1, k, "how do we rotate the auth token", "auth.py", 0.95, 0.1) for k in range(4)]
    put(rocks, tmp_path, rows)
    assert run(rocks, tmp_path, idle_ms=1) == []
    time.sleep(0.5)
    put(rocks, tmp_path, [(2, 9, "another", "b.py", 0.1, 0.1)])
    assert run(rocks, tmp_path, idle_ms=1) == []
    put(rocks, tmp_path, [(1, 10 + k, "how do we rotate the auth token", "auth.py", 0.95, 0.1) for k in range(4)])
    assert run(rocks, tmp_path, idle_ms=1) == []  # eight in all, but four were forgotten
    assert len(fold(rows + [(1, 10 + k, "how do we rotate the auth token", "auth.py", 0.95, 0.1) for k in range(4)])) == 1


def test_families():
    """Likeness, bounds, cooldown, the oldest family going, and baselines from outside."""
    f = crystals.Families({})
    events = [f.observe("rotate the auth token", "a.py,b.py", 0.9, 0.2, k) for k in range(60)]
    fired = [k for k, e in enumerate(events) if e]
    first = next(k for k in range(5, 61) if crystals.bound(0.9, min(16, k)) > 0.3) - 1
    assert fired == [first, first + 32] and events[first]["recipe"] == "a.py,b.py"
    for k in range(5):
        f.observe(f"unlike question {k} entirely{k}", f"z{k}.py", 0.85, 0.2, 100 + k)
    assert f.observe("rotate the auth token", "a.py,b.py", 0.9, 0.2, 200) is None  # those outside are as good
    g = crystals.Families({})
    for k in range(crystals.FAMILIES + 3):
        g.observe(f"word{k} alone{k}", f"p{k}.py", 0.5, 0.5, k)
    assert len(g.records) == crystals.FAMILIES and "f000000" not in g.records and g.gone == {"f000000", "f000001", "f000002"}
    assert crystals.bound(0.5, 0) == 0.0 and crystals.question_tokens("How's the CACHE, doing_it?!") == {"hows", "cache", "doing_it"}


def test_query_is_the_fold(spark, sf):
    """Outcomes made of the whole event log."""
    from siftwork.plans import QUERIES
    from siftwork.plans.crystals import outcomes as of_events

    rows = [tuple(r) for r in of_events(spark.read.parquet(f"{sf}/events.parquet")).collect()]
    got = sorted(tuple(r) for r in QUERIES["lrn19_crystallize"](spark, sf).collect())
    want = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in fold(rows)]
    assert got and got == want
