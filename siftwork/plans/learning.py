"""Queries on conversations, compression, feedback and learning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compress
from ..operators import conversation, dedup, learning
from .registry import query, table


def _r(x):
    return F.round(x, 6)


@query("conv1_prune_conversation")
def conv1(spark, sf):
    return conversation.prune(table(spark, sf, "conversations"), 400)


@query("conv2_score_block")
def conv2(spark, sf):
    return conversation.block_scores(table(spark, sf, "conversations")).select("conv_id", "turn", "kind", "tokens", _r("value").alias("value"))


@query("conv11_prune_aged", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 1 AND NOT starts_with(text, '[aged-pruned]') THEN '[aged-pruned] ' || left(string_split(text, chr(10))[1], 80) ELSE text END AS text FROM conversations")
def conv11(spark, sf):
    return conversation.digest_aged(table(spark, sf, "conversations"), "assistant", 1).select("conv_id", "turn", "text")


@query("conv12_compress_documents")
def conv12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", compress.compress_text(F.col("text")).alias("short"))
    return d.select("doc_id", F.length("text").alias("before"), F.length("short").alias("after"), F.md5("short").alias("digest"))


@query("conv15_universal_compress")
def conv15(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "><", ">\n<").alias("t"))
    return p.select("page_id", compress.content_type(F.col("t")).alias("kind"), F.md5(compress.compress_text(F.col("t"))).alias("digest"))


@query("conv20_compress_xml")
def conv20(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "><", ">\n<").alias("t"))
    return p.select("page_id", F.length(compress.compress_xml("t")).alias("after"))


@query("set7_json_schema")
def set7(spark, sf):
    return table(spark, sf, "events").select("event_id", compress.schema_of("props").alias("shape"))


@query("conv21_log_runs", """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)
SELECT conv_id, turn, line, min(i)::INT AS first, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL""")
def conv21(spark, sf):
    l = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where("trim(line) <> ''")
    return l.groupBy("conv_id", "turn", "line").agg((F.min("i") + 1).alias("first"), F.count("*").alias("n"))


@query("conv34_format_context", "SELECT conv_id, md5(string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn)) AS block FROM conversations GROUP BY conv_id")
def conv34(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line")))).alias("lines"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("block"))


@query("conv36_optimal_temperature", "WITH s AS (SELECT l_suppkey, avg(l_discount) AS h, stddev_pop(l_discount) AS sd FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(pow(h + 0.01, 0.25) * (0.2 + 0.6 / (1 + exp(-(0.5 - sd - 0.3)))), 4) AS temperature FROM s")
def conv36(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("h"), F.stddev_pop("l_discount").alias("sd"))
    return s.select("l_suppkey", F.round(F.pow(F.col("h") + 0.01, F.lit(0.25)) * (0.2 + 0.6 / (1 + F.exp(-(0.5 - F.col("sd") - 0.3)))), 4).alias("temperature"))


# ---- feedback ----

_WILSON = "(p + 1.9208 / n - 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)"
_RATES = "WITH g AS (SELECT source, count(*)::DOUBLE AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source)"


def _rates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return d.groupBy("source").agg(F.count("*").cast("double").alias("n"), F.avg("quality").alias("p"))


@query("lrn1_learned_value", f"{_RATES} SELECT source, round(0.5 + 1.5 * ({_WILSON}), 6) AS value FROM g")
def lrn1(spark, sf):
    return _rates(spark, sf).select("source", _r(0.5 + 1.5 * learning.wilson_lower(F.col("p"), F.col("n"))).alias("value"))


@query("lrn35_wilson_score", f"{_RATES} SELECT source, round({_WILSON}, 6) AS score FROM g")
def lrn35(spark, sf):
    return _rates(spark, sf).select("source", _r(learning.wilson_lower(F.col("p"), F.col("n"))).alias("score"))


@query("lrn3_reward_variance", "SELECT user_id, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.001, least(1.0, var_samp(value / 100))) END, 6)::DOUBLE AS variance FROM events GROUP BY user_id")
def lrn3(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(_r(learning.reward_variance(F.col("value") / 100)).alias("variance"))


@query("lrn4_ucb_score", "SELECT user_id, round(avg(value / 100) + 1 / ln(1000 + exp(1)) * sqrt(CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.001, least(1.0, var_samp(value / 100))) END / (count(*) + 1)), 6) AS ucb FROM events GROUP BY user_id")
def lrn4(spark, sf):
    v = F.col("value") / 100
    u = F.avg(v) + 1 / F.log(F.lit(1000.0) + F.exp(F.lit(1.0))) * F.sqrt(learning.reward_variance(v) / (F.count("*") + 1))
    return table(spark, sf, "events").groupBy("user_id").agg(_r(u).alias("ucb"))


@query("lrn11_information_reward", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity) * 1.1, 6) AS reward FROM lineitem GROUP BY l_suppkey")
def lrn11(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(_r(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity") * 1.1).alias("reward"))


@query("lrn12_modulated_reward", "SELECT event_id, round(CASE WHEN event_type <> 'error' THEN 0.5 + 0.5 * value / 100 ELSE -(1.5 - value / 100) END, 6)::DOUBLE AS reward FROM events")
def lrn12(spark, sf):
    return table(spark, sf, "events").select("event_id", _r(learning.modulated_reward(F.col("event_type") != "error", F.col("value") / 100)).alias("reward"))


@query("lrn14_implicit_reward", "SELECT event_id, round(least(1.0, sqrt(exp(-pow(value / 100 - 0.85, 2) / (2 * 0.04)) * exp(-pow((event_id % 100) / 100.0 - 0.4, 2) / (2 * 0.0225))) * 1.05), 6)::DOUBLE AS reward FROM events")
def lrn14(spark, sf):
    bell = lambda x, mid, width: F.exp(-F.pow(x - mid, F.lit(2.0)) / (2 * width * width))
    r = F.sqrt(bell(F.col("value") / 100, 0.85, 0.2) * bell((F.col("event_id") % 100) / 100, 0.40, 0.15)) * 1.05
    return table(spark, sf, "events").select("event_id", _r(F.least(F.lit(1.0), r)).alias("reward"))


@query("lrn16_reward_weighted", "WITH z AS (SELECT event_type, value, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS a FROM events) SELECT event_type, round(sum(value * greatest(a, 0)) / nullif(sum(greatest(a, 0)), 0), 6) AS attract, round(sum(value * greatest(-a, 0)) / nullif(sum(greatest(-a, 0)), 0), 6) AS repel FROM z GROUP BY event_type")
def lrn16(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    z = e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")))).withColumn("a", (F.col("value") - F.col("m")) / F.col("s"))
    up, down = F.greatest("a", F.lit(0.0)), F.greatest(-F.col("a"), F.lit(0.0))
    return z.groupBy("event_type").agg(_r(F.sum(F.col("value") * up) / F.nullif(F.sum(up), F.lit(0.0))).alias("attract"), _r(F.sum(F.col("value") * down) / F.nullif(F.sum(down), F.lit(0.0))).alias("repel"))


@query("lrn21_mmd_squared", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings WHERE label IN (0, 1)), k AS (SELECT a.label AS la, b.label AS lb, avg(exp(-pow(array_distance(a.v, b.v), 2) / 2)) AS k FROM e a, e b GROUP BY ALL)
SELECT round((SELECT k FROM k WHERE la = 0 AND lb = 0) + (SELECT k FROM k WHERE la = 1 AND lb = 1) - 2 * (SELECT k FROM k WHERE la = 0 AND lb = 1), 6) AS mmd""")
def lrn21(spark, sf):
    return learning.mmd_squared(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 1.0).select(_r("mmd").alias("mmd"))


@query("lrn22_silverman_bandwidth", "WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, k, stddev_samp(x) AS sd, count(*) AS n FROM v GROUP BY ALL) SELECT label, round(1.06 * avg(sd) * pow(max(n), -0.2), 6) AS width FROM s GROUP BY label")
def lrn22(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    s = v.groupBy("label", "k").agg(F.stddev_samp("x").alias("sd"), F.count("*").alias("n"))
    return s.groupBy("label").agg(_r(1.06 * F.avg("sd") * F.pow(F.max("n").cast("double"), F.lit(-0.2))).alias("width"))


@query("lrn27_thompson_gate", "WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') + 1.0 AS a, count(*) FILTER (event_type = 'error') + 1.0 AS b, avg(value) / 100 AS u FROM events GROUP BY user_id) SELECT user_id, round(0.6 * least(1.0, a / (a + b) + sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * 0.5) + 0.4 * u, 6)::DOUBLE AS score, 0.6 * least(1.0, a / (a + b) + sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) * 0.5) + 0.4 * u > 0.35 AS admit FROM g")
def lrn27(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") + 1.0).alias("a"), (F.count_if(F.col("event_type") == "error") + 1.0).alias("b"), (F.avg("value") / 100).alias("u"))
    s = learning.admission(F.col("a"), F.col("b"), F.lit(0.5), F.col("u"))
    return g.select("user_id", _r(s).alias("score"), (s > 0.35).alias("admit"))


@query("lrn29_invalidation_decay", "SELECT l_orderkey, round(exp(-ln(2) * sum(1.0 / l_linenumber) / count(*)), 6)::DOUBLE AS decay FROM lineitem GROUP BY l_orderkey")
def lrn29(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(_r(F.exp(-F.log(F.lit(2.0)) * F.sum(1.0 / F.col("l_linenumber")) / F.count("*"))).alias("decay"))


@query("lrn32_entropy_sketch", "WITH c AS (SELECT event_type, user_id, count(*)::DOUBLE AS n FROM events GROUP BY ALL) SELECT event_type, round(2 * log2(sum(n)) - log2(sum(n * n)), 6) AS h2 FROM c GROUP BY event_type")
def lrn32(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").cast("double").alias("n"))
    return c.groupBy("event_type").agg(_r(2 * F.log2(F.sum("n")) - F.log2(F.sum(F.col("n") * F.col("n")))).alias("h2"))


@query("lrn33_hit_predictor", "SELECT event_id, round(1 / (1 + exp(-(-0.5 + 0.02 * value + 0.3 * (event_id % 2)))), 6)::DOUBLE AS p FROM events")
def lrn33(spark, sf):
    return table(spark, sf, "events").select("event_id", _r(learning.logistic(-0.5 + 0.02 * F.col("value") + 0.3 * (F.col("event_id") % 2))).alias("p"))


@query("lrn36_cache_gc", f"{_RATES} SELECT source FROM g WHERE {_WILSON} >= 0.7")
def lrn36(spark, sf):
    return _rates(spark, sf).where(learning.wilson_lower(F.col("p"), F.col("n")) >= 0.7).select("source")


@query("lrn38_beta_posterior_mean", "SELECT user_id, event_type, round((count(*) FILTER (value > 50) + 1.0) / (count(*) + 2), 6)::DOUBLE AS mean FROM events GROUP BY ALL")
def lrn38(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(_r((F.count_if(F.col("value") > 50) + 1.0) / (F.count("*") + 2)).alias("mean"))


@query("lrn41_bayesian_route", "WITH g AS (SELECT user_id, count(*) + 2.0 AS n, count(*) FILTER (value > 40) + 1.0 AS a FROM events GROUP BY user_id) SELECT user_id, CASE WHEN n >= 5 AND a / n - 1.96 * sqrt(a * (n - a) / (n * n * (n + 1))) >= 0.3 THEN 'cheap' ELSE 'flagship' END AS model FROM g")
def lrn41(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg((F.count("*") + 2.0).alias("n"), (F.count_if(F.col("value") > 40) + 1.0).alias("a"))
    n, a = F.col("n"), F.col("a")
    low = a / n - 1.96 * F.sqrt(a * (n - a) / (n * n * (n + 1)))
    return g.select("user_id", F.when((n >= 5) & (low >= 0.3), "cheap").otherwise("flagship").alias("model"))


@query("lrn5_reward_ema", """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, r, value AS ema FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, 0.9 * f.ema + 0.1 * e.value FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, round(arg_max(ema, r), 6) AS ema FROM f GROUP BY user_id""")
def lrn5(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return learning.ema_by_key(e, "user_id", "event_id", "value", 0.1).select("user_id", _r("ema").alias("ema"))


@query("win19_cusum_drift")
def win19(spark, sf):
    return learning.cusum(table(spark, sf, "events"), "user_id", "event_id", (F.col("value") - 50) / 100)


@query("lrn13_online_weights")
def lrn13(spark, sf):
    return learning.online_weights(table(spark, sf, "events"), "event_id", ["click", "purchase", "error", "signup", "view"])


@query("sel33_budget_allocation")
def sel33(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("weight"), F.count("*").alias("demand"))
    return learning.allocate(a, "l_suppkey", 20_000)


@query("wit16_aggregate_risk", "SELECT l_suppkey, round(1 - exp(sum(l_tax * ln(1 - l_discount))), 6) AS risk FROM lineitem GROUP BY l_suppkey")
def wit16(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(_r(1 - F.exp(F.sum(F.col("l_tax") * F.log1p(-F.col("l_discount"))))).alias("risk"))


@query("wit20_conformal_quantile", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(min(value) FILTER (i >= least(n, greatest(1, ceil((n + 1) * 0.9)))), 6) AS q FROM r GROUP BY event_type")
def wit20(spark, sf):
    return learning.conformal_quantile(table(spark, sf, "events"), "event_type", "value", 0.1).select("event_type", _r("q").alias("q"))


@query("wit33_confusion_counts", "SELECT event_type, count(*) FILTER (value > 50 AND event_id % 2 = 0) AS tp, count(*) FILTER (value > 50 AND event_id % 2 = 1) AS fp, count(*) FILTER (value <= 50 AND event_id % 2 = 0) AS fn, count(*) FILTER (value <= 50 AND event_id % 2 = 1) AS tn FROM events GROUP BY event_type")
def wit33(spark, sf):
    said, true = F.col("value") > 50, F.col("event_id") % 2 == 0
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


@query("stm7_check_spike", "WITH s AS (SELECT user_id, event_id, value, count(*) OVER p AS n, avg(value) OVER p AS m, stddev_samp(value) OVER p AS sd FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, n >= 3 AND sd > 0 AND value > m + 1.5 * sd AS spike FROM s WHERE n >= 3")
def stm7(spark, sf):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    s = table(spark, sf, "events").select("event_id", "value", F.count("*").over(w).alias("n"), F.avg("value").over(w).alias("m"), F.stddev_samp("value").over(w).alias("sd")).where("n >= 3")
    return s.select("event_id", ((F.col("sd") > 0) & (F.col("value") > F.col("m") + 1.5 * F.col("sd"))).alias("spike"))


@query("stm9_poisson_surprise", "WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL), m AS (SELECT event_type, avg(n) AS e FROM d GROUP BY event_type) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(n * ln(n / e) - n + e, 6) AS surprise FROM d JOIN m USING (event_type)")
def stm9(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    m = d.groupBy("event_type").agg(F.avg("n").alias("e"))
    return d.join(F.broadcast(m), "event_type").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), _r(learning.poisson_surprise(F.col("n"), F.col("e"))).alias("surprise"))


@query("stm_tumbling_window", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm_window(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


@query("lrn39_knn_policy")
def lrn39(spark, sf):
    """The three most similar earlier labelled documents vote on a document's quality, unless the nearest is over 24 bits away."""
    d, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "quality")
    known = dedup.simhash(d.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"))
    near = dedup.nearest_earlier(dedup.simhash(d), known, max(1, -(-d.count() // 4000)), max(1, -(-labels.count() // 20_000)))
    return near.join(labels.withColumnRenamed("doc_id", "near"), "near").groupBy("doc_id").agg(_r(F.avg("quality")).alias("vote"), F.count("*").alias("n"))


