"""Queries on the bus: subscriptions, rates, priorities, queues, limits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bus, dedup
from .registry import query, table
from .relational import SIMHASH

_WANTED = {"planner": ("view", "click"), "auditor": ("error", "purchase", "signup"), "logger": ("view", "click", "error", "purchase", "signup")}
_SUBS = "sb(subscriber, event_type) AS (VALUES " + ", ".join(f"('{s}', '{t}')" for s, ts in _WANTED.items() for t in ts) + ")"


def _r(x):
    return F.round(x, 6)


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("seconds", bus.seconds(F.col("ts")))


@query("stm2_subscribe", f"WITH {_SUBS} SELECT subscriber, count(*) AS kinds FROM sb GROUP BY subscriber")
def stm2(spark, sf):
    return bus.subscriptions(spark, _WANTED).groupBy("subscriber").agg(F.count("*").alias("kinds"))


@query("stm1_publish", f"WITH {_SUBS} SELECT subscriber, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN sb USING (event_type) GROUP BY ALL")
def stm1(spark, sf):
    """Every event to the subscribers of its type."""
    out = bus.publish(table(spark, sf, "events"), bus.subscriptions(spark, _WANTED))
    return out.groupBy("subscriber", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stm10_poisson_rate", """WITH RECURSIVE g AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
r AS (SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS rate FROM g WHERE k = 0 UNION ALL SELECT r.user_id, g.k, 0.9 * rate + 0.1 / greatest(gap, 0.001) FROM r JOIN g ON g.user_id = r.user_id AND g.k = r.k + 1)
SELECT user_id, round(max_by(rate, k), 6) AS rate, max(k) AS n FROM r GROUP BY user_id HAVING max(k) > 0""")
def stm10(spark, sf):
    return bus.rates(_events(spark, sf), "user_id").select("user_id", _r("rate").alias("rate"), "n")


@query("stm11_welford", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY user_id")
def stm11(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean"), _r(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("deviation"))


_NEAR = f"{SIMHASH}, c AS (SELECT doc_id, source, simhash, list(simhash) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING) AS before FROM f JOIN documents USING (doc_id)), nv AS (SELECT doc_id, source, simhash, CASE WHEN before IS NULL OR len(before) = 0 THEN 0.8 ELSE 0.85 * tanh((1 - list_max(list_transform(before, lambda h: 1 - bit_count(xor(simhash, h)) / 64))) / 0.85) END AS novelty FROM c)"


def novelties(spark, sf):
    """Documents as events of their sources, each against the 128 before it."""
    s = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text")).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    before = F.collect_list("simhash").over(W.partitionBy("source").orderBy("doc_id").rowsBetween(-128, -1))
    return s.withColumn("before", before).withColumn("novelty", bus.novelty(F.col("simhash"), F.col("before"))).drop("before")


@query("stm5_novelty", f"WITH {_NEAR} SELECT doc_id, round(novelty, 6)::DOUBLE AS novelty FROM nv")
def stm5(spark, sf):
    return novelties(spark, sf).select("doc_id", _r("novelty").alias("novelty"))


_TASK = "tk AS (SELECT simhash AS h FROM f WHERE doc_id = 7)"


def informed(spark, sf):
    """novelties with how much each tells of the task (document 7), one row to all."""
    n = novelties(spark, sf)
    t = n.where("doc_id = 7").select(F.col("simhash").alias("h"))
    return n.crossJoin(F.broadcast(t)).withColumn("information", bus.task_information(1 - dedup.hamming(F.col("simhash"), F.col("h")) / 64))


@query("stm6_mutual_info", f"WITH {_NEAR}, {_TASK} SELECT doc_id, round(0.2 + 1.8 * (1 - bit_count(xor(simhash, h)) / 64), 6)::DOUBLE AS information FROM nv, tk")
def stm6(spark, sf):
    return informed(spark, sf).select("doc_id", _r("information").alias("information"))


_PRIO = f"""{_NEAR}, {_TASK}, z AS (SELECT doc_id, source, n_chars, avg(n_chars) OVER (PARTITION BY source) AS m, max(doc_id) OVER () AS now FROM documents),
pr AS (SELECT doc_id, nv.source, (1 + n_chars * ln(n_chars / m) / m - n_chars / m + 1) * exp(-ln(2.0) * (now - doc_id) / 100) * novelty * (0.2 + 1.8 * (1 - bit_count(xor(simhash, h)) / 64)) AS priority FROM nv JOIN z USING (doc_id), tk)"""


def priorities(spark, sf):
    """Documents by surprise (their length against their source's), age, novelty and what they tell of the task."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    means = d.groupBy(F.col("source").alias("_of")).agg(F.avg("n_chars").alias("m"))
    d = d.join(F.broadcast(means), F.col("source").eqNullSafe(F.col("_of"))).crossJoin(F.broadcast(d.agg(F.max("doc_id").alias("now"))))
    p = informed(spark, sf).drop("source").join(d, "doc_id")
    return p.select("doc_id", "source", bus.priority(bus.surprise(F.col("n_chars"), F.col("m")), F.col("now") - F.col("doc_id"), F.col("novelty"), F.col("information"), F.lit(1.0)).alias("priority"))


@query("stm4_priority", f"WITH {_PRIO} SELECT doc_id, round(priority, 6)::DOUBLE AS priority FROM pr")
def stm4(spark, sf):
    return priorities(spark, sf).select("doc_id", _r("priority").alias("priority"))


@query("stm8_enqueue", f"WITH {_PRIO}, q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY round(priority, 9) DESC, doc_id) AS place FROM pr) SELECT doc_id, source, place::INT AS place FROM q WHERE place <= 16")
def stm8(spark, sf):
    """What each source's queue of sixteen holds."""
    p = priorities(spark, sf).withColumn("priority", F.round("priority", 9))
    return bus.enqueue(p, "source", "priority", "doc_id", 16).select("doc_id", "source", "place")


@query("stm3_drain", f"WITH {_PRIO} SELECT doc_id, round(priority, 6)::DOUBLE AS priority FROM pr ORDER BY round(priority, 9) DESC, doc_id LIMIT 10")
def stm3(spark, sf):
    """The ten events of the highest priority."""
    return priorities(spark, sf).orderBy(F.desc(F.round("priority", 9)), "doc_id").limit(10).select("doc_id", _r("priority").alias("priority"))


@query("stm12_suppress_repeats", "WITH e AS (SELECT event_id, event_type, user_id, props, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), g AS (SELECT *, k - lag(k) OVER (PARTITION BY event_type, user_id, props ORDER BY k) AS gap FROM e) SELECT event_id, event_type FROM g WHERE gap IS NULL OR gap > 256")
def stm12(spark, sf):
    out = bus.suppress_repeats(table(spark, sf, "events"), "event_type", F.concat_ws("|", "user_id", "props"), "event_id")
    return out.select("event_id", "event_type")


@query("stm13_due_jobs", "WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last, 600 * (1 + count(*) FILTER (event_type = 'error')) AS every FROM events GROUP BY user_id) SELECT user_id, every::BIGINT AS every FROM l, m WHERE epoch(now) - epoch(last) >= every")
def stm13(spark, sf):
    """Jobs whose time has come: the last run and an interval that grows with failures."""
    e = table(spark, sf, "events")
    l = e.groupBy("user_id").agg(F.max("ts").alias("last"), (600 * (1 + F.count_if(F.col("event_type") == "error"))).alias("every"))
    late = (bus.micros(F.col("now")) - bus.micros(F.col("last"))) / 1e6 >= F.col("every")
    return l.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(late).select("user_id", "every")


@query("stm14_bridge_events", "WITH m AS (SELECT event_type, avg(value) + 2 * stddev_pop(value) AS top FROM events GROUP BY event_type) SELECT event_id, event_type, round(value, 6) AS value FROM events JOIN m USING (event_type) WHERE value > top")
def stm14(spark, sf):
    """Salient events for the memory: two deviations over the mean of their type."""
    e = table(spark, sf, "events")
    m = e.groupBy("event_type").agg((F.avg("value") + 2 * F.stddev_pop("value")).alias("top"))
    return e.join(F.broadcast(m), "event_type").where("value > top").select("event_id", "event_type", _r("value").alias("value"))


@query("stm16_implicit_feedback", "WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) FILTER (before = event_type AND gap < 3600) AS rephrased, count(*) FILTER (before IS NOT NULL AND gap >= 3600) AS sessions, round(avg(CASE WHEN before = event_type AND gap < 3600 THEN -0.5 WHEN before IS NULL THEN 0.0 ELSE 0.5 END), 6)::DOUBLE AS reward FROM s GROUP BY user_id")
def stm16(spark, sf):
    """A client that asks the same again soon was not served; one that goes on was."""
    w = W.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf, "events").withColumn("before", F.lag("event_type").over(w)).withColumn("gap", (bus.micros(F.col("ts")) - bus.micros(F.lag("ts").over(w))) / 1e6)
    again = F.coalesce((F.col("before") == F.col("event_type")) & (F.col("gap") < 3600), F.lit(False))
    reward = F.when(again, -0.5).when(F.col("before").isNull(), 0.0).otherwise(0.5)
    return s.groupBy("user_id").agg(F.count_if(again).alias("rephrased"), F.count_if(F.col("before").isNotNull() & (F.col("gap") >= 3600)).alias("sessions"), _r(F.avg(reward)).alias("reward"))


@query("stm17_token_bucket", """WITH RECURSIVE g AS (SELECT event_type AS k, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
r AS (SELECT k, i, t, 4.0::DOUBLE AS l, 1::BIGINT AS passed FROM g WHERE i = 1 UNION ALL SELECT g.k, g.i, g.t, CASE WHEN least(5.0, l + (g.t - r.t) * 0.001) >= 1 THEN least(5.0, l + (g.t - r.t) * 0.001) - 1 ELSE least(5.0, l + (g.t - r.t) * 0.001) END, passed + (least(5.0, l + (g.t - r.t) * 0.001) >= 1)::BIGINT FROM r JOIN g ON g.k = r.k AND g.i = r.i + 1)
SELECT k AS event_type, max(passed) AS passed, max(i) - max(passed) AS dropped FROM r GROUP BY k""")
def stm17(spark, sf):
    """How many events of each type a bucket of five tokens, one more every thousand seconds, lets through."""
    return bus.token_bucket(_events(spark, sf), "event_type", "event_id", "seconds", 0.001, 5)


@query("stm19_snapshot_ttl", "WITH r AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT e.event_id, (epoch(e.ts) - epoch(r.at)) <= 3600 AS joined FROM events e JOIN r USING (user_id) WHERE e.event_type = 'purchase' AND e.ts >= r.at")
def stm19(spark, sf):
    """Outcomes after a fragment's last snapshot: joined within an hour, else too late."""
    e = table(spark, sf, "events")
    r = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("at"))
    o = e.where("event_type = 'purchase'").join(r, "user_id").where("ts >= at")
    return o.select("event_id", ((bus.micros(F.col("ts")) - bus.micros(F.col("at"))) / 1e6 <= 3600).alias("joined"))


@query("win20_shift_detector", """WITH RECURSIVE g AS (SELECT user_id, (value > 50)::INT::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0.5::DOUBLE AS ema, 0.0::DOUBLE AS down, 0 AS wait, 0 AS found FROM g
 UNION ALL SELECT user_id, i, ema, CASE WHEN d > 1.0 AND wait <= 0 THEN 0.0 ELSE d END, CASE WHEN d > 1.0 AND wait <= 0 THEN 20 ELSE greatest(wait - 1, 0) END, found + (d > 1.0 AND wait <= 0)::INT
 FROM (SELECT r.user_id, g.i, 0.97 * ema + (1 - 0.97::DOUBLE) * h AS ema, greatest(0.0, down + (0.97 * ema + (1 - 0.97::DOUBLE) * h) - h - 0.05) AS d, wait, found FROM r JOIN g ON g.user_id = r.user_id AND g.i = r.i + 1))
SELECT user_id, max(i) AS n, round(max_by(ema, i), 6) AS ema, max(found)::INT AS shifts FROM r GROUP BY user_id""")
def win20(spark, sf):
    out = bus.shifts(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 50)
    return out.select("user_id", "n", _r("ema").alias("ema"), "shifts")
