"""Queries on fragments: documents with the features that selection weighs, and what is learnt from their use."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, fragments, selection
from .registry import query, table
from .relational import SIMHASH, TERMS
from .samples import PATHS, pick, sql_pick
from .scalars import BYTES, _criticality_sql

_SEMANTIC = "(" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS) + f") / {len(TERMS)}"
_N = "(wins + losses)"
_LOWER = f"((wins / {_N} + 1.9208 / {_N} - 1.96 * sqrt((wins / {_N} * (1 - wins / {_N}) + 0.9604 / {_N}) / {_N})) / (1 + 3.8416 / {_N}))"
FRAGMENTS = f"""{BYTES},
us AS (SELECT user_id, max(event_id) AS last, count(*) AS accesses, count(*) FILTER (event_type = 'purchase') AS wins, count(*) FILTER (event_type = 'error') AS losses FROM events GROUP BY user_id),
tt AS (SELECT max(last) AS now, max(accesses) AS most FROM us),
fr AS (SELECT doc_id, {sql_pick(PATHS, 'doc_id')} AS path, greatest(1, octet_length(encode(text)) // 4) AS tokens, least(h1 / 6, 1.0) AS entropy, coalesce(exp(-ln(2.0) * (now - last) / (now / 10 + 1)), 0.0) AS recency,
 coalesce(accesses, 0) / most AS frequency, {_SEMANTIC} AS semantic, CASE WHEN {_N} > 0 THEN 0.5 + 1.5 * {_LOWER} ELSE 1.0 END AS feedback, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(accesses, 0) AS accesses
 FROM e LEFT JOIN us ON user_id = doc_id, tt),
sc AS (SELECT *, (0.3 * recency + 0.25 * frequency + 0.25 * semantic + 0.2 * entropy) * greatest(feedback, 0.01) AS score FROM fr)"""


def _r(x):
    return F.round(x, 6)


def features(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"), "text")
    return fragments.features(d, table(spark, sf, "events"), TERMS)


def scored(spark, sf):
    return features(spark, sf).withColumn("score", fragments.linear_score())


@query("src10_batch_ingest", f"WITH {FRAGMENTS} SELECT doc_id, tokens, round(entropy, 6)::DOUBLE AS entropy, round(recency, 6)::DOUBLE AS recency, round(frequency, 6)::DOUBLE AS frequency, round(semantic, 6)::DOUBLE AS semantic, round(feedback, 6)::DOUBLE AS feedback FROM fr")
def src10(spark, sf):
    """Every fragment with its features, in one pass over the documents and one aggregate of the log."""
    return features(spark, sf).select("doc_id", "tokens", *[_r(c).alias(c) for c in ("entropy", "recency", "frequency", "semantic", "feedback")])


@query("sel2_linear_score", f"WITH {FRAGMENTS} SELECT doc_id, round(score, 6)::DOUBLE AS score FROM sc")
def sel2(spark, sf):
    return scored(spark, sf).select("doc_id", _r("score").alias("score"))


@query("join10_context_score", f"WITH {FRAGMENTS}, {SIMHASH}, q AS (SELECT simhash AS qh FROM f WHERE doc_id = 7) SELECT doc_id, round(least(1.0, feedback * (0.45 * (1 - bit_count(xor(simhash, qh)) / 64) + 0.25 * recency + 0.2 * entropy + 0.1 * frequency)), 6)::DOUBLE AS score FROM fr JOIN f USING (doc_id), q")
def join10(spark, sf):
    """Each fragment's score for the one that is asked about; its fingerprint is one row to all."""
    s = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text"))
    q = s.where("doc_id = 7").select(F.col("simhash").alias("qh"))
    near = 1 - dedup.hamming(F.col("simhash"), F.col("qh")) / 64
    return features(spark, sf).join(s, "doc_id").crossJoin(F.broadcast(q)).select("doc_id", _r(fragments.context_score(near)).alias("score"))


@query("sel7_pinned_relevance", f"WITH {FRAGMENTS}, cr AS (SELECT *, {_criticality_sql()} AS kind FROM (SELECT *, lower(path) AS p FROM sc) AS x) SELECT count(*) AS n, sum(tokens)::BIGINT AS tokens, round(sum(score), 5)::DOUBLE AS relevance FROM cr WHERE kind IN ('safety', 'critical')")
def sel7(spark, sf):
    """What is pinned, whatever the budget: safety and critical files."""
    return scored(spark, sf).where(fragments.pinned()).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("score"), 5).alias("relevance"))


@query("sel22_ordering_priority", f"WITH {FRAGMENTS}, cr AS (SELECT *, {_criticality_sql()} AS kind FROM (SELECT *, lower(path) AS p FROM sc) AS x) SELECT doc_id, round(score + CASE WHEN kind IN ('safety', 'critical') THEN 100 ELSE 0 END + CASE kind WHEN 'safety' THEN 50 WHEN 'critical' THEN 30 WHEN 'important' THEN 10 ELSE 0 END + least(accesses, 20), 6)::DOUBLE AS priority FROM cr")
def sel22(spark, sf):
    return scored(spark, sf).select("doc_id", _r(fragments.ordering_priority(F.col("score"), F.col("accesses"))).alias("priority"))


@query("sel3_lambda_star", f"""WITH RECURSIVE {FRAGMENTS},
bs AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN u > 8000 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN u > 8000 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT k, any_value(lo) AS lo, any_value(hi) AS hi, sum(tokens / (1 + exp(-(score - (lo + hi) / 2 * tokens) / 0.5))) AS u FROM bs, sc WHERE k < 45 GROUP BY k))
SELECT round(hi, 6) AS price FROM bs WHERE k = 45""")
def sel3(spark, sf):
    """The price of a token at which the expected use meets the budget: a grid of prices in each pass."""
    s = scored(spark, sf).select("doc_id", "tokens", "score")
    return spark.createDataFrame([(round(selection.lambda_star(s, 8000), 6),)], "price double")


@query("sel25_explain_selection", f"""
WITH RECURSIVE {FRAGMENTS}, o AS (SELECT *, row_number() OVER (ORDER BY score / tokens DESC, doc_id) AS r FROM sc),
g AS (SELECT 0::BIGINT AS r, 8000::BIGINT AS room, NULL::BIGINT AS doc_id UNION ALL SELECT o.r, CASE WHEN o.tokens <= g.room THEN g.room - o.tokens ELSE g.room END, CASE WHEN o.tokens <= g.room THEN o.doc_id END FROM g JOIN o ON o.r = g.r + 1)
SELECT sc.doc_id, round(0.3 * recency, 6)::DOUBLE AS recency, round(0.25 * frequency, 6)::DOUBLE AS frequency, round(0.25 * semantic, 6)::DOUBLE AS semantic, round(0.2 * entropy, 6)::DOUBLE AS entropy, round(feedback, 6)::DOUBLE AS feedback, g.doc_id IS NOT NULL AS included FROM sc LEFT JOIN g USING (doc_id)""")
def sel25(spark, sf):
    """What each feature gives a fragment, and whether the greedy fill of the budget took it."""
    s = scored(spark, sf)
    taken = selection.greedy_fill(s, 8000).select("doc_id", F.lit(True).alias("included"))
    parts = [_r(w * F.col(c)).alias(c) for c, w in fragments.WEIGHTS.items()]
    return s.join(F.broadcast(taken), "doc_id", "left").select("doc_id", *parts, _r("feedback").alias("feedback"), F.coalesce("included", F.lit(False)).alias("included"))


@query("sel1_knapsack_optimize")
def sel1(spark, sf):
    """Pinned fragments first, then the soft selection of the others under what is left."""
    s = scored(spark, sf).select("doc_id", "path", "tokens", "score")
    kept = selection.greedy_fill(s.where(fragments.pinned()), 4000).select("doc_id", "tokens")
    used = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rest = selection.soft_select(s.where(~fragments.pinned()), 8000 - used).select("doc_id", "tokens")
    return kept.withColumn("pinned", F.lit(True)).unionByName(rest.withColumn("pinned", F.lit(False)))


@query("sel15_allocate_budget", f"WITH {FRAGMENTS}, m AS (SELECT path, 40 * count(*) AS budget, avg(entropy) AS h FROM fr GROUP BY path), a AS (SELECT path, budget, greatest(50, least(500, floor(budget * 0.05)))::BIGINT AS l1, floor(budget * CASE WHEN h < 0.4 THEN 0.20 WHEN h < 0.7 THEN 0.25 ELSE 0.35 END)::BIGINT AS l2 FROM m) SELECT path, l1, l2, greatest(0, budget - l1 - l2)::BIGINT AS l3 FROM a")
def sel15(spark, sf):
    """The budget of each module by levels: more for outlines where the mean entropy is high."""
    m = features(spark, sf).groupBy("path").agg((40 * F.count("*")).alias("budget"), F.avg("entropy").alias("h"))
    b = F.col("budget")
    one = F.greatest(F.lit(50), F.least(F.lit(500), F.floor(b * 0.05))).cast("long")
    two = F.floor(b * F.when(F.col("h") < 0.4, 0.20).when(F.col("h") < 0.7, 0.25).otherwise(0.35)).cast("long")
    return m.select("path", one.alias("l1"), two.alias("l2"), F.greatest(F.lit(0), b - one - two).cast("long").alias("l3"))


@query("sel36_drop_lowest", f"""WITH {FRAGMENTS}, u AS (SELECT path, doc_id, ceil(tokens * 0.01)::BIGINT AS cost, sum(ceil(tokens * 0.01)::BIGINT) OVER (PARTITION BY path ORDER BY round(score, 9) DESC, doc_id) AS used FROM sc) SELECT path, doc_id, cost, used::BIGINT AS used FROM u WHERE used <= 60""")
def sel36(spark, sf):
    """All fragments of a module as references, the least relevant dropped until the rest fits; scores count to nine places."""
    s = scored(spark, sf).withColumn("cost", F.ceil(F.col("tokens") * 0.01).cast("long"))
    return selection.ranked_fill(s, "path", 60, [F.desc(F.round("score", 9)), F.asc("doc_id")], "cost").select("path", "doc_id", "cost", "used")


@query("ret14_precision", f"WITH {FRAGMENTS} SELECT doc_id, round(semantic * CASE WHEN recency < 0.05 THEN 0.1 ELSE 1.0 END, 6)::DOUBLE AS precision FROM fr")
def ret14(spark, sf):
    """Relevance, a tenth of it for what is stale."""
    return features(spark, sf).select("doc_id", _r(F.col("semantic") * F.when(F.col("recency") < 0.05, 0.1).otherwise(1.0)).alias("precision"))


@query("sel24_sufficiency", "WITH r AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS symbol FROM lineitem), d AS (SELECT p_partkey AS symbol FROM part WHERE p_size > 25) SELECT src, round(avg((d.symbol IS NOT NULL)::INT), 6) AS sufficiency FROM r LEFT JOIN d USING (symbol) GROUP BY src")
def sel24(spark, sf):
    """Of the symbols that each source refers to, the share that the selection defines."""
    refs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("symbol")).distinct()
    defined = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("symbol"), F.lit(1).alias("here"))
    return refs.join(defined, "symbol", "left").groupBy("src").agg(_r(F.avg(F.coalesce("here", F.lit(0)))).alias("sufficiency"))


# ---- causal graph of use ----

_EFFECTS = """b AS (SELECT avg((value > 50)::INT) AS base FROM events),
f AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS ni, avg((value > 50)::INT) FILTER (event_type = 'click') AS i, avg((value > 50)::INT) FILTER (event_type <> 'click') AS o, count(*) AS n FROM events GROUP BY user_id),
ef AS (SELECT user_id, coalesce(i, o) - base AS effect, CASE WHEN i IS NULL OR o IS NULL THEN 0.0 ELSE o - i END AS bias, CASE WHEN ni > 0 THEN sqrt(ni) / (sqrt(ni) + sqrt(3)) ELSE 0.3 * sqrt(n) / (sqrt(n) + sqrt(3)) END AS confidence FROM f, b)"""


def effects(spark, sf):
    """Fragments (users) by how much an intervention (a click) moves the rate of good outcomes from the base."""
    good, tried = (F.col("value") > 50).cast("int"), F.col("event_type") == "click"
    e = table(spark, sf, "events")
    f = e.groupBy("user_id").agg(F.count_if(tried).alias("ni"), F.avg(F.when(tried, good)).alias("i"), F.avg(F.when(~tried, good)).alias("o"), F.count("*").alias("n"))
    f = f.crossJoin(F.broadcast(e.agg(F.avg(good).alias("base"))))  # one row
    sure = lambda n: F.sqrt(n) / (F.sqrt(n) + F.sqrt(F.lit(3.0)))
    return f.select(
        "user_id", (F.coalesce("i", "o") - F.col("base")).alias("effect"), F.coalesce(F.col("o") - F.col("i"), F.lit(0.0)).alias("bias"),
        F.when(F.col("ni") > 0, sure(F.col("ni"))).otherwise(0.3 * sure(F.col("n"))).alias("confidence"),
    )


@query("win9_causal_effects", f"WITH {_EFFECTS} SELECT user_id, round(effect, 6)::DOUBLE AS effect, round(bias, 6)::DOUBLE AS bias, round(confidence, 6)::DOUBLE AS confidence FROM ef")
def win9(spark, sf):
    return effects(spark, sf).select("user_id", *[_r(c).alias(c) for c in ("effect", "bias", "confidence")])


@query("win12_top_causal", f"WITH {_EFFECTS} SELECT user_id, round(effect * confidence, 6)::DOUBLE AS worth FROM ef ORDER BY abs(worth) DESC, user_id LIMIT 10")
def win12(spark, sf):
    e = effects(spark, sf).select("user_id", _r(F.col("effect") * F.col("confidence")).alias("worth"))
    return e.orderBy(F.desc(F.abs("worth")), "user_id").limit(10)


_LINKS = "s AS (SELECT event_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), ln AS (SELECT before, event_type, count(*) AS n, max(event_id) AS last, avg(value) AS outcome FROM s WHERE before IS NOT NULL GROUP BY ALL)"


def links(spark, sf):
    """What followed what in each fragment's use: how often, when last, and the mean outcome."""
    s = table(spark, sf, "events").withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))).where("before is not null")
    return s.groupBy("before", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.avg("value").alias("outcome"))


@query("win11_decay_tick", f"WITH {_LINKS} SELECT before, event_type, n, last FROM ln WHERE last >= (SELECT max(event_id) FROM events) - 50")
def win11(spark, sf):
    """Links that were seen within the last 50 turns; older ones are dropped."""
    now = table(spark, sf, "events").agg(F.max("event_id").alias("now"))
    return links(spark, sf).crossJoin(F.broadcast(now)).where("last >= now - 50").select("before", "event_type", "n", "last")


@query("win13_top_chains", f"WITH {_LINKS}, m AS (SELECT event_type, avg(value) AS marginal FROM events GROUP BY event_type) SELECT before, ln.event_type, n, round(outcome - marginal, 6) AS effect FROM ln JOIN m USING (event_type) ORDER BY effect DESC, before, event_type LIMIT 5")
def win13(spark, sf):
    """The links whose outcome is most above what the second alone gives."""
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("marginal"))
    l = links(spark, sf).join(F.broadcast(m), "event_type").withColumn("effect", _r(F.col("outcome") - F.col("marginal")))
    return l.orderBy(F.desc("effect"), "before", "event_type").limit(5).select("before", "event_type", "n", "effect")
