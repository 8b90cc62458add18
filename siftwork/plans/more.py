"""Further queries: overlaps, utilisation, caches, verdicts, budgets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, evidence, graph, learning
from .registry import query, table
from .relational import _EDGES, _SETS, SIMHASH, _links, _pair_sets
from .samples import PATHS, QUESTIONS, pick, sql_any, sql_pick


def _r(x):
    return F.round(x, 6)


def _tri(w: str) -> str:
    return f"list_distinct(list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"


_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_TRI = f"""
p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), q AS (SELECT conv_id, turn, {_W.format('text')} AS a, {_W.format('before')} AS b FROM p WHERE before IS NOT NULL),
s AS (SELECT conv_id, turn, CASE WHEN len(a) < 3 OR len(b) < 3 THEN 0.0 ELSE len(list_intersect({_tri('a')}, {_tri('b')})) / len(list_distinct({_tri('a')} || {_tri('b')})) END AS tri, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS ident,
 CASE WHEN len({_tri('a')}) = 0 THEN 0.0 ELSE len(list_intersect({_tri('a')}, {_tri('b')})) / len({_tri('a')}) END AS tc, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END AS ic FROM q)"""


def _overlaps(spark, sf):
    """Word sets and trigrams of each turn (a) and the one before (b)."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    c = c.select("conv_id", "turn", X.words_of(F.col("text")).alias("wa"), X.words_of(F.col("before")).alias("wb"))
    return c.select("conv_id", "turn", "wa", "wb", F.array_distinct("wa").alias("a"), F.array_distinct("wb").alias("b"), F.array_distinct(X.ngrams(F.col("wa"), 3)).alias("ta"), F.array_distinct(X.ngrams(F.col("wb"), 3)).alias("tb"))


def _tri_jaccard():
    return F.when((F.size("wa") < 3) | (F.size("wb") < 3), 0.0).otherwise(X.jaccard(F.col("ta"), F.col("tb")))


@query("join14_trigram_jaccard", f"WITH {_TRI} SELECT conv_id, turn, round(tri, 6)::DOUBLE AS jaccard FROM s")
def join14(spark, sf):
    return _overlaps(spark, sf).select("conv_id", "turn", _r(_tri_jaccard()).alias("jaccard"))


@query("join15_identifier_jaccard", f"WITH {_TRI} SELECT conv_id, turn, round(ident, 6)::DOUBLE AS jaccard FROM s")
def join15(spark, sf):
    return _overlaps(spark, sf).select("conv_id", "turn", _r(X.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


@query("join13_content_overlap", f"WITH {_TRI} SELECT conv_id, turn, round(0.5 * tri + 0.5 * ident, 6)::DOUBLE AS overlap FROM s")
def join13(spark, sf):
    return _overlaps(spark, sf).select("conv_id", "turn", _r(0.5 * _tri_jaccard() + 0.5 * X.jaccard(F.col("a"), F.col("b"))).alias("overlap"))


@query("agg10_score_utilization", f"WITH {_TRI} SELECT conv_id, turn, round(0.4 * tc + 0.6 * ic, 6)::DOUBLE AS utilization, 0.4 * tc + 0.6 * ic > 0.1 AS used FROM s")
def agg10(spark, sf):
    share = lambda x, y: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    u = 0.4 * share("ta", "tb") + 0.6 * share("a", "b")
    return _overlaps(spark, sf).select("conv_id", "turn", _r(u).alias("utilization"), (u > 0.1).alias("used"))


@query("join9_lsh_key", f"WITH {SIMHASH} SELECT doc_id, (((simhash >> 3) & 1) + 2 * ((simhash >> 17) & 1) + 4 * ((simhash >> 29) & 1) + 8 * ((simhash >> 44) & 1) + 16 * ((simhash >> 60) & 1))::BIGINT AS key FROM f")
def join9(spark, sf):
    s = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text"))
    return s.select("doc_id", evidence.bit_key(F.col("simhash"), (3, 17, 29, 44, 60)).alias("key"))


@query("join7_lsh_candidates")
def join7(spark, sf):
    """Candidates of document 7 in twelve tables of ten bits, with the flips of three bits probed too."""
    s = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text"))
    return evidence.lsh_candidates(s, s.where("doc_id = 7"))


@query("join12_semantic_dedup")
def join12(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.token_count(F.col("text")).alias("tokens"), X.words_of(F.col("text")).alias("w"))
    return evidence.greedy_dedup(c, "conv_id", "turn", "w", 0.7)


@query("join25_prefetch", "WITH u AS (SELECT l_partkey AS id, l_discount AS c FROM lineitem UNION ALL SELECT p_partkey, p_size / 500.0 FROM part) SELECT id, round(max(c), 6)::DOUBLE AS confidence FROM u GROUP BY id ORDER BY confidence DESC, id LIMIT 10")
def join25(spark, sf):
    u = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("c")).unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 500.0).alias("c")))
    return u.groupBy("id").agg(_r(F.max("c")).alias("confidence")).orderBy(F.desc("confidence"), "id").limit(10)


@query("join5_remove", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def join5(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 0"), "doc_id", "left_anti")


@query("join29_filter_group_chat", "WITH m AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r <= 2 ORDER BY s DESC, turn) AS q FROM m) SELECT conv_id, turn FROM k WHERE r <= 2 OR q <= 1")
def join29(spark, sf):
    """The last turns and the longest of the others."""
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("s"), F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("r"))
    k = m.withColumn("q", F.row_number().over(W.partitionBy("conv_id", F.col("r") <= 2).orderBy(F.desc("s"), "turn")))
    return k.where("r <= 2 or q <= 1").select("conv_id", "turn")


@query("ret18_identify_cluster", f"WITH {_EDGES}, u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), x AS (SELECT 2 AS id, 0 AS d UNION ALL SELECT b, 1 FROM u WHERE a = 2), y AS (SELECT u.b AS id, 2 AS d FROM x JOIN u ON u.a = x.id WHERE d = 1) SELECT id, min(d)::INT AS depth FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY id")
def ret18(spark, sf):
    return graph.reach(_links(spark, sf), spark.sql("select 2L as id"), 2, both_ways=True)


@query("ret25_build_provenance", "WITH s AS (SELECT l_orderkey, avg((l_discount > 0.03)::INT) AS verified, avg(l_tax * 10) AS confidence FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN verified < 0.7 THEN 'high' WHEN confidence < 0.25 OR verified < 0.9 THEN 'medium' ELSE 'low' END AS risk FROM s")
def ret25(spark, sf):
    """The mean of taxes is compared at twelve places: its last bit depends on the order of the lines, in SQL as well."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_discount") > 0.03).cast("int")).alias("v"), F.avg(F.col("l_tax") * 10).alias("c"))
    return s.select("l_orderkey", F.when(F.col("v") < 0.7, "high").when((F.round("c", 12) < 0.25) | (F.col("v") < 0.9), "medium").otherwise("low").alias("risk"))


@query("ret26_trace_provenance")
def ret26(spark, sf):
    """How much of each answer's identifiers stands in the question before it, by longest matches."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' and before is not null")
    return c.select("conv_id", "turn", _r(evidence.grounded_share("text", "before")).alias("grounded"))


@query("sel9_diversity_factor", f"WITH {SIMHASH} SELECT a.doc_id, round(greatest(1 - max(1 - bit_count(xor(a.simhash, b.simhash)) / 64), 0.1), 6)::DOUBLE AS factor FROM f a, f b WHERE b.doc_id < 10 AND a.doc_id >= 10 GROUP BY a.doc_id")
def sel9(spark, sf):
    """Diversity against ten chosen documents: their fingerprints, ten by the query, are one row to all."""
    s = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text"))
    chosen = s.where("doc_id < 10").agg(F.collect_list("simhash").alias("chosen"))
    near = F.array_max(F.transform("chosen", lambda h: 1 - dedup.hamming(F.col("simhash"), h) / 64))
    return s.where("doc_id >= 10").crossJoin(F.broadcast(chosen)).select("doc_id", _r(F.greatest(1 - near, F.lit(0.1))).alias("factor"))


@query("sel32_optimal_budget", "WITH a AS (SELECT l_linenumber / 10.0 AS b, avg(l_discount) AS acc FROM lineitem GROUP BY l_linenumber), t AS (SELECT max_by(acc, b) AS top FROM a) SELECT round(greatest(0.05, least(0.95, min(b))), 6)::DOUBLE AS budget FROM a, t WHERE acc >= 0.95 * top")
def sel32(spark, sf):
    a = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") / 10.0).alias("b")).agg(F.avg("l_discount").alias("acc"))
    top = a.agg(F.max_by("acc", "b").alias("top"))
    return a.crossJoin(F.broadcast(top)).where("acc >= 0.95 * top").agg(_r(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.min("b")))).alias("budget"))


@query("sel34_reinforce", "WITH r AS (SELECT l_suppkey, avg(l_discount) AS x FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(greatest(0.1, least(10, 1 + 0.5 * (x - avg(x) OVER ()))), 6)::DOUBLE AS weight FROM r")
def sel34(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("x"))
    return r.crossJoin(F.broadcast(r.agg(F.avg("x").alias("m")))).select("l_suppkey", _r(F.greatest(F.lit(0.1), F.least(F.lit(10.0), 1 + 0.5 * (F.col("x") - F.col("m"))))).alias("weight"))


@query("agg19_gate_status", "SELECT event_type, CASE WHEN count(*) < 100 THEN 'insufficient' WHEN avg((value > 50)::INT) >= 0.45 THEN 'open' ELSE 'closed' END AS gate FROM events GROUP BY event_type")
def agg19(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.when(F.count("*") < 100, "insufficient").when(F.avg((F.col("value") > 50).cast("int")) >= 0.45, "open").otherwise("closed").alias("gate"))


@query("agg20_shadow_agreement", "SELECT event_type, round(avg((event_id % 3 = user_id % 3)::INT), 6) AS agreement FROM events GROUP BY event_type")
def agg20(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(_r(F.avg((F.col("event_id") % 3 == F.col("user_id") % 3).cast("int"))).alias("agreement"))


@query("agg25_aggregate_contributions", "WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(x), 6) AS mean FROM r WHERE n < 3 OR (i > greatest(1, n // 10) AND i <= n - greatest(1, n // 10)) GROUP BY event_type")
def agg25(spark, sf):
    from ..operators.health import trimmed_mean

    return trimmed_mean(table(spark, sf, "events"), "event_type", "value").select("event_type", _r("mean").alias("mean"))


@query("lrn2_welford_rewards", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(var_samp(value) * (count(*) - 1), 0), 4) AS m2 FROM events GROUP BY user_id")
def lrn2(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean"), F.round(F.coalesce(F.var_samp("value") * (F.count("*") - 1), F.lit(0.0)), 4).alias("m2"))


@query("lrn23_rbf_eval", "SELECT a.vec_id, round(exp(-pow(array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 2) / 2), 6) AS k FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def lrn23(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("o"))
    d2 = F.aggregate(F.zip_with("v", "o", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return e.crossJoin(F.broadcast(one)).select("vec_id", _r(F.exp(-d2 / 2)).alias("k"))


@query("lrn20_persona_assign", "SELECT a.vec_id, min_by(b.vec_id, struct_pack(d := round(array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 9), i := b.vec_id)) AS persona FROM embeddings a, embeddings b WHERE b.vec_id < 8 GROUP BY a.vec_id")
def lrn20(spark, sf):
    """The nearest of eight archetypes, one row to all."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    eight = e.where("vec_id < 8").agg(F.collect_list(F.struct("vec_id", "v")).alias("all"))
    distance = lambda c: F.round(F.sqrt(F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)), 9)
    near = F.array_min(F.transform("all", lambda s: F.struct(distance(s["v"]).alias("d"), s["vec_id"].alias("i"))))
    return e.crossJoin(F.broadcast(eight)).select("vec_id", near["i"].alias("persona"))


@query("lrn25_cache_lookup", "WITH c AS (SELECT md5(lower(trim(text))) AS h, min(conv_id * 1000 + turn) AS entry FROM conversations GROUP BY 1) SELECT conv_id, turn, entry, entry <> conv_id * 1000 + turn AS hit FROM conversations JOIN c ON h = md5(lower(trim(text)))")
def lrn25(spark, sf):
    """An exact cache: each question against the first that was equal."""
    q = table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.lower(F.trim("text"))).alias("h"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    c = q.groupBy("h").agg(F.min("id").alias("entry"))
    return q.join(c, "h").select("conv_id", "turn", "entry", (F.col("entry") != F.col("id")).alias("hit"))


@query("lrn28_entry_value", "SELECT event_type, round((ln(1 + count(*)) + avg(value) / 100) * exp(-0.1) * 0.8, 6)::DOUBLE AS worth FROM events GROUP BY event_type")
def lrn28(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(_r((F.log1p(F.count("*").cast("double")) + F.avg("value") / 100) * F.exp(F.lit(-0.1)) * 0.8).alias("worth"))


@query("lrn31_frequency", "SELECT user_id, least(255, count(*)) AS n FROM events GROUP BY user_id")
def lrn31(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.least(F.lit(255), F.count("*")).alias("n"))


@query("lrn37_cache_stats", "SELECT count(*) AS lookups, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50) / count(*), 6) AS rate FROM events")
def lrn37(spark, sf):
    hit = F.col("value") > 50
    return table(spark, sf, "events").agg(F.count("*").alias("lookups"), F.count_if(hit).alias("hits"), _r(F.count_if(hit) / F.count("*")).alias("rate"))


@query("lrn40_logistic_failure")
def lrn40(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 100).alias("x"), (F.col("event_type") == "error").cast("int").alias("y"))
    return learning_fold(e)


def learning_fold(e):
    """Online logistic regression by key: the weights after the last row."""
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "x", "y"))).alias("rows"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("b"))

    def step(a, r):
        off = r["y"] - learning.logistic(a["w"] * r["x"] + a["b"])
        return F.struct((a["w"] + 0.1 * off * r["x"]).alias("w"), (a["b"] + 0.1 * off).alias("b"))

    return rows.select("user_id", F.aggregate("rows", start, step).alias("m")).select("user_id", _r("m.w").alias("w"), _r("m.b").alias("b"))


@query("win7_temporal_bonus", "WITH e AS (SELECT user_id, event_type, avg(value) AS effect, count(*) AS n, count(*) / (count(*) + 3.0) AS conf FROM events GROUP BY ALL) SELECT user_id, round(sum(effect * conf) / sum(conf), 6)::DOUBLE AS bonus FROM e WHERE conf > 0.2 AND n >= 2 GROUP BY user_id")
def win7(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("effect"), F.count("*").alias("n")).withColumn("conf", F.col("n") / (F.col("n") + 3.0))
    return e.where("conf > 0.2 and n >= 2").groupBy("user_id").agg(_r(F.sum(F.col("effect") * F.col("conf")) / F.sum("conf")).alias("bonus"))


@query("win10_temporal_effects", "WITH s AS (SELECT event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), m AS (SELECT event_type, avg(value) AS marginal FROM s GROUP BY event_type) SELECT before, s.event_type, round(avg(value) - any_value(marginal), 6) AS effect FROM s JOIN m USING (event_type) WHERE before IS NOT NULL GROUP BY ALL")
def win10(spark, sf):
    s = table(spark, sf, "events").withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")))
    m = s.groupBy("event_type").agg(F.avg("value").alias("marginal"))
    return s.where("before is not null").join(F.broadcast(m), "event_type").groupBy("before", "event_type").agg(_r(F.avg("value") - F.first("marginal")).alias("effect"))


@query("wit17_risk_predict", "SELECT event_id, round(1 / (1 + exp(-(-1.2 + 0.015 * value + 0.1 * (event_id % 4)))), 6)::DOUBLE AS risk FROM events")
def wit17(spark, sf):
    return table(spark, sf, "events").select("event_id", _r(learning.logistic(-1.2 + 0.015 * F.col("value") + 0.1 * (F.col("event_id") % 4))).alias("risk"))


@query("wit27_reasoning_chain")
def wit27(spark, sf):
    """How much each step of a conversation is needed for its end."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.query_terms(F.col("text"))).alias("t"))
    end = c.groupBy("conv_id").agg(F.max_by("t", "turn").alias("end"), F.max("turn").alias("last"))
    return c.join(end, "conv_id").where("turn < last").select("conv_id", "turn", _r(X.jaccard(F.col("t"), F.col("end"))).alias("necessity"))



@query("flt33_cache_align", f"WITH {_SETS} SELECT conv_id, turn, len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))) >= 0.9 AS reuse FROM s")
def flt33(spark, sf):
    u = F.greatest(F.lit(1), F.size(F.array_union("a", "b")))
    return _pair_sets(spark, sf).select("conv_id", "turn", (F.size(F.array_intersect("a", "b")) / u >= 0.9).alias("reuse"))


@query("flt20_contradiction_guard", f"WITH {SIMHASH}, d AS (SELECT doc_id, simhash, {sql_pick(PATHS, 'doc_id')} AS path FROM f) SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.path = b.path AND a.doc_id < b.doc_id AND 1 - bit_count(xor(a.simhash, b.simhash)) / 64 < 0.55")
def flt20(spark, sf):
    """Fragments of one path whose contents disagree: a similarity under 0.55 is 29 bits of 64 or more."""
    s = dedup.simhash(table(spark, sf, "documents").select("doc_id", "text")).withColumn("path", pick(PATHS, F.col("doc_id")))
    return dedup.far_pairs(s, "path", 29)


