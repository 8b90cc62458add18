"""Queries on duplicates, ranking, graphs, selection, health and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import information as I
from ..functions import text as X
from ..operators import dedup, graph, health, retrieval, selection
from .registry import query, table
from .samples import PATHS, listed, pick, sql_any, sql_pick
from .scalars import BOILER, BYTES

_S = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(text, '{_S}')"
_NORM = f"md5(array_to_string({_WORDS}, ' '))"
TERMS = ["the", "and", "ing", "token", "con", "der"]


def _r(x):
    return F.round(x, 6)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# ---- duplicates and overlaps ----


@query("join2_content_hash", f"SELECT doc_id, {_NORM} AS hash FROM documents")
def join2(spark, sf):
    return _docs(spark, sf).select("doc_id", dedup.content_hash(F.col("text")).alias("hash"))


@query("join4_exact_dedup", f"WITH h AS (SELECT doc_id, {_NORM} AS hash FROM documents) SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY hash) <> doc_id THEN min(doc_id) OVER (PARTITION BY hash) END AS duplicate_of FROM h")
def join4(spark, sf):
    return dedup.mark_duplicates(_docs(spark, sf))


SIMHASH = f"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_S}') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
m AS (SELECT doc_id, md5_number_upper(g)::UBIGINT AS h FROM g),
v AS (SELECT doc_id, b, sum((h >> b) & 1) AS ones, count(*) AS n FROM m, unnest(range(0, 64)) AS r(b) GROUP BY doc_id, b),
s AS (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN (CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b) END) ELSE 0 END)::BIGINT AS simhash FROM v GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(simhash, 0) AS simhash FROM documents LEFT JOIN s USING (doc_id))"""


@query("join1_simhash", f"WITH {SIMHASH} SELECT doc_id, simhash FROM f")
def join1(spark, sf):
    return dedup.simhash(_docs(spark, sf))


@query("join6_extract_bands", f"WITH {SIMHASH}, u AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS band, simhash FROM f) SELECT doc_id, band::INT AS band, ((simhash >> (16 * band)) & 65535)::BIGINT AS slice FROM u")
def join6(spark, sf):
    return dedup.simhash(_docs(spark, sf)).select("doc_id", F.inline(dedup.bands(F.col("simhash"), 3)))


@query("join3_close_pairs", f"WITH {SIMHASH}, d AS (SELECT min(doc_id) AS id, simhash FROM f GROUP BY simhash) SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM d a JOIN d b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3")
def join3(spark, sf):
    return dedup.close_pairs(dedup.simhash(_docs(spark, sf)), 3)


@query("join16_detect_clones", f"WITH {SIMHASH}, d AS (SELECT min(doc_id) AS id, simhash FROM f GROUP BY simhash) SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance, CASE WHEN bit_count(xor(a.simhash, b.simhash)) <= 2 THEN 'type1' WHEN bit_count(xor(a.simhash, b.simhash)) <= 8 THEN 'type2' ELSE 'type3' END AS kind FROM d a JOIN d b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 16")
def join16(spark, sf):
    return dedup.pairs_within(dedup.simhash(_docs(spark, sf)), 16).withColumn("kind", dedup.clone_type(F.col("distance")))


def _grams_sql(n: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"g{n} AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {joined})) AS g FROM ww), c{n} AS (SELECT g, count(*) > 1 AS again FROM g{n} GROUP BY g), r{n} AS (SELECT doc_id, avg(again::INT) AS r FROM g{n} JOIN c{n} USING (g) GROUP BY doc_id)"


REDUNDANCY = f"""
ww AS (SELECT doc_id, {_WORDS} AS w FROM documents), {_grams_sql(2)}, {_grams_sql(3)}, {_grams_sql(4)},
rr AS (SELECT doc_id, len(w) AS n, coalesce(r2.r, 0) AS x, CASE WHEN len(w) >= 3 THEN coalesce(r3.r, 0) ELSE coalesce(r2.r, 0) END AS y, CASE WHEN len(w) >= 4 THEN coalesce(r4.r, 0) WHEN len(w) >= 3 THEN coalesce(r3.r, 0) ELSE coalesce(r2.r, 0) END AS z
 FROM ww LEFT JOIN r2 USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r4 USING (doc_id)),
red AS (SELECT doc_id, CASE WHEN n < 2 THEN 0.0 WHEN n < 20 THEN 0.55 * x + 0.35 * y + 0.1 * z WHEN n < 100 THEN 0.25 * x + 0.5 * y + 0.25 * z ELSE 0.15 * x + 0.35 * y + 0.5 * z END AS redundancy FROM rr)"""


@query("inf16_ngram_redundancy", f"WITH ww AS (SELECT doc_id, {_WORDS} AS w FROM documents), {_grams_sql(3)} SELECT doc_id, round(r, 6) AS redundancy FROM r3")
def inf16(spark, sf):
    return dedup.gram_shares(_docs(spark, sf), (3,)).where("s3 is not null").select("doc_id", _r("s3").alias("redundancy"))


@query("inf15_cross_fragment_redundancy", f"WITH {REDUNDANCY} SELECT doc_id, round(redundancy, 6)::DOUBLE AS redundancy FROM red")
def inf15(spark, sf):
    return dedup.redundancy(_docs(spark, sf)).select("doc_id", _r("redundancy").alias("redundancy"))


_DIV = "greatest(h1 - h2, 0.0)"
_SCORE = f"greatest(0.0, least(1.0, 0.4 * least(h1 / 6, 1.0) + 0.3 * (1 - {BOILER}) + 0.3 * (1 - redundancy) - CASE WHEN {_DIV} > 1.5 THEN least({_DIV} - 1.5, 1.0) * 0.15 ELSE 0.0 END))"


def _scored(spark, sf):
    d = _docs(spark, sf).select("doc_id", I.shannon_entropy("text").alias("h1"), I.renyi_entropy_2("text").alias("h2"), X.boilerplate_ratio(F.col("text")).alias("bp"), X.token_count(F.col("text")).alias("tokens"))
    return d.join(dedup.redundancy(_docs(spark, sf)), "doc_id").select("doc_id", "tokens", I.information_score(F.col("h1"), F.col("h2"), F.col("bp"), F.col("redundancy")).alias("information"))


@query("inf17_information_score", f"WITH {BYTES}, {REDUNDANCY} SELECT doc_id, round({_SCORE}, 6)::DOUBLE AS score FROM e JOIN red USING (doc_id)")
def inf17(spark, sf):
    return _scored(spark, sf).select("doc_id", _r("information").alias("score"))


def _pair_sets(spark, sf):
    """Each turn against the one before: the operators on pairs of sets."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return c.select("conv_id", "turn", F.array_distinct(X.words_of(F.col("text"))).alias("a"), F.array_distinct(X.words_of(F.col("before"))).alias("b"), "text", "before")


_SETS = r"p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(before), '[\p{L}\p{N}_]+')) AS b FROM p WHERE before IS NOT NULL)"


@query("set1_jaccard", f"WITH {_SETS} SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6)::DOUBLE AS jaccard FROM s")
def set1(spark, sf):
    return _pair_sets(spark, sf).select("conv_id", "turn", _r(X.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


@query("set4_intersection_ratio", f"WITH {_SETS} SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6)::DOUBLE AS ratio FROM s")
def set4(spark, sf):
    return _pair_sets(spark, sf).select("conv_id", "turn", _r(F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.lit(1))).alias("ratio"))


@query("set5_coverage_fraction", f"WITH {_SETS} SELECT conv_id, turn, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS missing FROM s")
def set5(spark, sf):
    return _pair_sets(spark, sf).select("conv_id", "turn", F.size(F.array_except("a", "b")).cast("long").alias("missing"))


@query("set2_merge_fragments", """
WITH a AS (SELECT user_id, event_id AS turn, value FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS turn, value FROM events WHERE event_type <> 'view'), u AS (SELECT *, 0 AS peer FROM a UNION ALL SELECT *, 1 FROM b)
SELECT user_id, turn, value, peer FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC, peer) AS r FROM u) WHERE r = 1""")
def set2(spark, sf):
    """The newest of each id from two sides, the local one on a tie: by partial aggregation, not a window."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("turn"), "value", (F.col("event_type") != "view").cast("int").alias("peer"))
    return e.groupBy("user_id").agg(F.max(F.struct("turn", (-F.col("peer")).alias("p"), "value")).alias("m")).select("user_id", "m.turn", "m.value", (-F.col("m.p")).alias("peer"))


@query("join20_first_by_prefix", "WITH h AS (SELECT doc_id, md5(left(text, 256)) AS h FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY h")
def join20(spark, sf):
    """The fragment of each beginning that comes first; the rule itself compares the first 256 characters."""
    return _docs(spark, sf).groupBy(F.md5(F.substring("text", 1, 256)).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("join19_traces_with_outcomes", """
WITH t AS (SELECT user_id, max(event_id) AS trace FROM events WHERE event_type = 'view' GROUP BY user_id), o AS (SELECT user_id, count(*) AS outcomes, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, trace, coalesce(outcomes, 0) AS outcomes, round(coalesce(total, 0), 4) AS total FROM t LEFT JOIN o USING (user_id)""")
def join19(spark, sf):
    e = table(spark, sf, "events")
    t = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("trace"))
    o = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("outcomes"), F.sum("value").alias("total"))
    return t.join(o, "user_id", "left").select("user_id", "trace", F.coalesce("outcomes", F.lit(0)).alias("outcomes"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query("join21_attribute_paths", """
WITH r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), m AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT coalesce(r.user_id, m.user_id) AS user_id, CASE WHEN r.user_id IS NULL THEN 'miss' WHEN m.user_id IS NULL THEN 'unverified' ELSE 'hit' END AS verdict FROM r FULL JOIN m ON r.user_id = m.user_id""")
def join21(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'purchase')")
    k = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "view").alias("r"), F.bool_or(F.col("event_type") == "purchase").alias("m"))
    return k.select("user_id", F.when(~F.col("r"), "miss").when(~F.col("m"), "unverified").otherwise("hit").alias("verdict"))


# ---- retrieval ----

_CODE = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({listed(C.CODE_STOP_WORDS)}))"
_BM25 = f"""
k AS (SELECT doc_id, {_CODE} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM k), x AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM k),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN ({listed(TERMS)}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, count(*) AS matched, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / greatest(a, 1)))) AS base FROM tf JOIN df USING (term), st GROUP BY doc_id),
sc AS (SELECT doc_id, matched, base + pow(matched / {len(TERMS)}, 1.5) * 0.5 * base AS score FROM bm)"""


@query("ret3_bm25", f"WITH {_BM25} SELECT doc_id, matched, round(score, 6) AS score FROM sc")
def ret3(spark, sf):
    return retrieval.bm25(_docs(spark, sf), TERMS).withColumn("score", _r("score"))


@query("ret2_bm25_idf", f"WITH {_BM25} SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st")
def ret2(spark, sf):
    d = _docs(spark, sf)
    df = d.select("doc_id", F.explode(F.array_distinct(X.code_terms(F.col("text")))).alias("term")).where(F.col("term").isin(*TERMS)).groupBy("term").count()
    return df.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("term", _r(F.log((F.col("n") - F.col("count") + 0.5) / (F.col("count") + 0.5) + 1)).alias("idf"))


@query("ret1_bm25_index", f"WITH {_BM25}, v AS (SELECT DISTINCT doc_id, term FROM x) SELECT term, count(*) AS df FROM v GROUP BY term")
def ret1(spark, sf):
    return _docs(spark, sf).select(F.explode(F.array_distinct(X.code_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("ret4_normalize_scores", f"WITH {_BM25} SELECT doc_id, round(greatest(0.05, least(1.0, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 0.95 + 0.05)), 6)::DOUBLE AS score FROM sc")
def ret4(spark, sf):
    return retrieval.min_max(retrieval.bm25(_docs(spark, sf), TERMS), "score").select("doc_id", _r("score").alias("score"))


@query("ret_rank_percentile", f"WITH {_BM25}, q AS (SELECT doc_id, round(score, 6) AS score FROM sc) SELECT doc_id, round(greatest(0.05, least(1.0, 0.95 * (1 - (row_number() OVER (ORDER BY score DESC, doc_id) - 1) / count(*) OVER ()) + 0.05)), 6)::DOUBLE AS percentile FROM q")
def ret_rank(spark, sf):
    s = ret3(spark, sf)
    return retrieval.rank_percentile(s, "score", "doc_id").select("doc_id", _r("percentile").alias("percentile"))


@query("ret15_tfidf_cosine", f"""
WITH k AS (SELECT doc_id, unnest({_CODE}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL), idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
q AS (SELECT term, idf FROM idf WHERE term IN ({listed(TERMS)})), d AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS dn FROM tf JOIN idf USING (term) GROUP BY doc_id),
p AS (SELECT doc_id, sum(tf * q.idf * q.idf) AS dot FROM tf JOIN q USING (term) GROUP BY doc_id)
SELECT doc_id, round(dot / (dn * (SELECT sqrt(sum(idf * idf)) FROM q)), 6) AS cosine FROM p JOIN d USING (doc_id) WHERE dot / (dn * (SELECT sqrt(sum(idf * idf)) FROM q)) > 0.01""")
def ret15(spark, sf):
    return retrieval.tfidf_cosine(_docs(spark, sf), TERMS).withColumn("cosine", _r("cosine"))


@query("ret5_key_terms", f"WITH {_BM25} SELECT term, round(ln((SELECT n FROM st) / (1 + df)) + 1, 6) AS weight FROM df ORDER BY weight DESC, term LIMIT 3")
def ret5(spark, sf):
    d = _docs(spark, sf)
    df = d.select(F.explode(F.array_distinct(X.code_terms(F.col("text")))).alias("term")).where(F.col("term").isin(*TERMS)).groupBy("term").count()
    out = df.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("term", _r(F.log(F.col("n") / (1 + F.col("count"))) + 1).alias("weight"))
    return out.orderBy(F.desc("weight"), "term").limit(3)


@query("ret6_recall", f"WITH {SIMHASH}, q AS (SELECT simhash AS qh FROM f WHERE doc_id = 7) SELECT doc_id, round(1 - bit_count(xor(simhash, qh)) / 64, 6) AS similarity FROM f, q WHERE doc_id <> 7 ORDER BY similarity DESC, doc_id LIMIT 10")
def ret6(spark, sf):
    """The ten fragments most similar to one, by fingerprint: a top-k over a scan, with the one value broadcast."""
    s = dedup.simhash(_docs(spark, sf))
    q = s.where("doc_id = 7").select(F.col("simhash").alias("qh"))
    near = s.where("doc_id <> 7").crossJoin(F.broadcast(q)).select("doc_id", _r(1 - dedup.hamming(F.col("simhash"), F.col("qh")) / 64).alias("similarity"))
    return near.orderBy(F.desc("similarity"), "doc_id").limit(10)


# ---- graphs: suppliers and parts of line items ----

_EDGES = "ed AS (SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem)"


def _links(spark, sf):
    """Edges, repeated as line items repeat them."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.lit(1000000000) + F.col("l_partkey")).alias("dst"))


def _edges(spark, sf):
    return _links(spark, sf).distinct()


def _nodes(e):
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {_EDGES}, nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed), cn AS (SELECT count(*)::DOUBLE AS n FROM nd), od AS (SELECT src, count(*) AS o FROM ed GROUP BY src), r0 AS (SELECT id, 1 / n AS rank FROM nd, cn)"
    for k in range(rounds):
        out += f", l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM od)), g{k} AS (SELECT dst AS id, sum(rank / o) AS given FROM ed JOIN od USING (src) JOIN r{k} ON r{k}.id = ed.src GROUP BY dst), r{k + 1} AS (SELECT nd.id, 0.15 / n + 0.85 * (coalesce(given, 0) + lost / n) AS rank FROM nd LEFT JOIN g{k} USING (id), cn, l{k})"
    return f"{out} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query("ret17_pagerank", _pagerank_sql(4))
def ret17(spark, sf):
    e = _edges(spark, sf)
    return graph.pagerank(_nodes(e), e, 4).select("id", F.round("rank", 8).alias("rank"))


@query("ret19_transitive_deps", f"WITH {_EDGES}, a AS (SELECT DISTINCT dst FROM ed WHERE src = 1), b AS (SELECT DISTINCT e2.src AS id FROM a JOIN ed e2 ON e2.dst = a.dst WHERE e2.src <> 1) SELECT dst AS id, 1 AS depth FROM a UNION ALL SELECT id, 2 FROM b UNION ALL SELECT 1, 0")
def ret19(spark, sf):
    return graph.reach(_links(spark, sf), spark.sql("select 1L as id"), 2, both_ways=True).where("depth <= 2")


@query("ret20_reverse_deps", f"WITH {_EDGES} SELECT dst AS id, count(*) AS deps FROM ed GROUP BY dst")
def ret20(spark, sf):
    return _edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deps"))


@query("ret21_dep_boosts", f"WITH {_EDGES}, s AS (SELECT dst AS id, count(*) * 0.7 AS x FROM ed WHERE src BETWEEN 1 AND 3 GROUP BY dst) SELECT id, round(x / max(x) OVER (), 6)::DOUBLE AS boost FROM s")
def ret21(spark, sf):
    e = _edges(spark, sf).withColumn("strength", F.lit(0.7))
    return graph.dependency_boosts(e, e.sparkSession.range(1, 4)).select("id", _r("boost").alias("boost"))


@query("ret22_connected_components", "WITH RECURSIVE ed AS (SELECT s_suppkey AS src, 1000 + s_nationkey AS dst FROM supplier), u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def ret22(spark, sf):
    e = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), (F.lit(1000) + F.col("s_nationkey")).cast("long").alias("dst"))
    return graph.components(e)


@query("ret23_graph_counts", f"WITH {_EDGES} SELECT (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM (SELECT src FROM ed UNION SELECT dst FROM ed)) AS nodes")
def ret23(spark, sf):
    e = _edges(spark, sf)
    return e.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(_nodes(e).agg(F.count("*").alias("nodes"))))  # one row each


@query("join17_auto_link", """
WITH d AS (SELECT user_id AS symbol, event_id AS seq FROM events WHERE event_type = 'signup'), r AS (SELECT user_id AS symbol, event_id AS seq FROM events WHERE event_type = 'purchase')
SELECT r.seq AS src, max(d.seq) AS dst, symbol FROM r JOIN d USING (symbol) WHERE d.seq < r.seq GROUP BY r.seq, symbol""")
def join17(spark, sf):
    """Each use of a symbol to the latest definition before it."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("symbol"), "event_type")
    return graph.symbol_edges(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"))


@query("join18_register_symbol", "SELECT user_id AS symbol, max(event_id) AS id FROM events WHERE event_type = 'signup' GROUP BY user_id")
def join18(spark, sf):
    return table(spark, sf, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("symbol")).agg(F.max("event_id").alias("id"))


# ---- selection ----

_ITEMS = "i AS (SELECT doc_id, greatest(1, octet_length(encode(text)) // 4) AS tokens, (doc_id * 7919 % 1000 + 1) / 1000.0::DOUBLE AS score FROM documents)"


def _items(spark, sf):
    return _docs(spark, sf).select("doc_id", X.token_count(F.col("text")).alias("tokens"), ((F.col("doc_id") * 7919 % 1000 + 1) / 1000.0).alias("score"))


@query("sel6_knapsack_greedy", f"""
WITH RECURSIVE {_ITEMS}, o AS (SELECT *, row_number() OVER (ORDER BY score / tokens DESC, doc_id) AS r FROM i), f AS (SELECT 0::BIGINT AS r, 8000::BIGINT AS free, NULL::BIGINT AS doc_id, 0 AS place, NULL::BIGINT AS tokens, NULL::DOUBLE AS score
 UNION ALL SELECT o.r, CASE WHEN o.tokens <= f.free THEN f.free - o.tokens ELSE f.free END, CASE WHEN o.tokens <= f.free THEN o.doc_id END, f.place + CASE WHEN o.tokens <= f.free THEN 1 ELSE 0 END, o.tokens, o.score FROM f JOIN o ON o.r = f.r + 1)
SELECT doc_id, tokens, score, (place - 1)::INT AS place FROM f WHERE doc_id IS NOT NULL""")
def sel6(spark, sf):
    return selection.greedy_fill(_items(spark, sf), 8000)


@query("sel5_knapsack_dp")
def sel5(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", X.token_count(F.col("text")).alias("tokens"), ((F.col("doc_id") * 7919 % 1000 + 1) / 1000.0).alias("score"))
    return selection.knapsack_groups(d, "source", "doc_id", "score", "tokens", 6000)


@query("sel4_soft_selection")
def sel4(spark, sf):
    return selection.soft_select(_items(spark, sf), 8000)


@query("sel8_multi_resolution")
def sel8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    rows = _items(spark, sf).join(dedup.simhash(_docs(spark, sf)), "doc_id").join(d, "doc_id")
    return selection.multi_resolution(rows, "source", "doc_id", "score", "tokens", "simhash", 6000)


@query("sel10_pairwise_diversity", f"WITH {SIMHASH} SELECT (SELECT count(*) FROM f) AS n, round((SELECT avg(bit_count(xor(a.simhash, b.simhash)) / 64) FROM f a JOIN f b ON a.doc_id < b.doc_id), 6) AS diversity")
def sel10(spark, sf):
    return selection.pairwise_diversity(dedup.simhash(_docs(spark, sf))).select("n", _r("diversity").alias("diversity"))


@query("sel16_submodular_gain", f"WITH {_ITEMS}, d AS (SELECT doc_id, source, score FROM i JOIN documents USING (doc_id)) SELECT doc_id, round(score / row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id), 6) AS gain FROM d")
def sel16(spark, sf):
    rows = _items(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return selection.marginal_gain(rows, "source", "score", "doc_id").select("doc_id", _r("gain").alias("gain"))


@query("sel11_ranked_fill", f"WITH {_ITEMS}, d AS (SELECT doc_id, source, tokens, score FROM i JOIN documents USING (doc_id)), u AS (SELECT source, doc_id, sum(tokens) OVER (PARTITION BY source ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM d) SELECT * FROM u WHERE used <= 20000")
def sel11(spark, sf):
    rows = _items(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return selection.ranked_fill(rows, "source", 20000, [F.desc("score"), "doc_id"]).select("source", "doc_id", "used")


@query("ret9_mmr")
def ret9(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.token_count(F.col("text")).alias("tokens"), X.query_terms(F.col("text")).alias("terms"))
    return selection.mmr(c.withColumn("score", F.size("terms") / (F.size("terms") + 20)), "conv_id", "turn", "score", "tokens", "terms", 300)


# ---- health ----


@query("agg1_scan_anomalies", """
WITH m AS (SELECT o_orderpriority AS grp, median(o_totalprice) AS med, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT o_orderkey, grp, o_totalprice AS x, med, n, abs(o_totalprice - med) AS dev FROM orders JOIN m ON grp = o_orderpriority),
a AS (SELECT grp, median(dev) AS mad FROM d GROUP BY grp), z AS (SELECT o_orderkey, grp, n, 0.6745 * (x - med) / mad AS z FROM d JOIN a USING (grp) WHERE n >= 5 AND mad >= 1e-9)
SELECT o_orderkey, grp, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind, round(z, 6) AS z, round(0.5 * least(n / 10, 1.0) + 0.5 * least((abs(z) - 2.5) / 2, 1.0), 6) AS confidence FROM z WHERE abs(z) >= 2.5""")
def agg1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"))
    return health.anomalies(o, "o_orderkey", "grp", "x").select("o_orderkey", "grp", "kind", _r("z").alias("z"), _r("confidence").alias("confidence"))


@query("agg2_median", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY ALL")
def agg2(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_r(F.median("l_extendedprice")).alias("median"))


@query("agg4_dead_symbols", r"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS s FROM documents), c AS (SELECT s, count(*) AS n, min(doc_id) AS doc_id FROM w GROUP BY s) SELECT doc_id, count(*) AS dead FROM c WHERE n = 1 GROUP BY doc_id")
def agg4(spark, sf):
    return health.dead_symbols(_docs(spark, sf))


@query("agg5_god_files", f"WITH {_EDGES}, c AS (SELECT dst AS id, count(*) AS deps FROM ed GROUP BY dst), s AS (SELECT avg(deps) + 2 * stddev_pop(deps) AS top FROM c) SELECT id, deps FROM c, s WHERE deps > top AND deps >= 3")
def agg5(spark, sf):
    return health.god_files(_edges(spark, sf))


def _layer_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any('contains', f'lower({x})', parts)} THEN {k}" for k, (_, parts) in enumerate(C.LAYERS)) + " END"


@query("agg6_arch_violations", f"WITH p AS (SELECT doc_id, {sql_pick(PATHS, 'doc_id')} AS path, 'import ' || {sql_pick(PATHS, '(doc_id + 11)')} AS line FROM documents), l AS (SELECT doc_id, path, {_layer_sql('path')} AS a, {_layer_sql('line')} AS b FROM p) SELECT doc_id, path, a::INT AS importer, b::INT AS imported FROM l WHERE a <> 5 AND b > a + 1")
def agg6(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"), F.concat(F.lit("import "), pick(PATHS, F.col("doc_id") + 11)).alias("content"))
    return health.layer_violations(p).select("doc_id", "path", "importer", "imported")


@query("agg7_naming_issues", f"""
WITH p AS (SELECT doc_id, {sql_pick(PATHS, 'doc_id')} AS path FROM documents), s AS (SELECT doc_id, path, regexp_extract(path, '([^/.]*)\\.[^/.]*$', 1) AS stem FROM p)
SELECT doc_id, path, CASE WHEN regexp_matches(path, '\\.(py|rs)$') AND regexp_matches(stem, '[A-Z]') THEN 'snake_case' WHEN regexp_matches(path, '\\.(js|ts|jsx|tsx)$') AND contains(path, '/components/') AND NOT regexp_matches(stem, '^[A-Z]') THEN 'PascalCase' END AS expected FROM s WHERE length(stem) >= 3
AND ((regexp_matches(path, '\\.(py|rs)$') AND regexp_matches(stem, '[A-Z]')) OR (regexp_matches(path, '\\.(js|ts|jsx|tsx)$') AND contains(path, '/components/') AND NOT regexp_matches(stem, '^[A-Z]')))""")
def agg7(spark, sf):
    return health.naming_issues(table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path")))


@query("agg9_health_grade", "WITH s AS (SELECT l_suppkey, 100 * (1 - avg(l_discount) * 5) AS score FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(score, 6) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def agg9(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((100 * (1 - F.avg("l_discount") * 5)).alias("score"))
    return s.select("l_suppkey", _r("score").alias("score"), health.grade(F.col("score")).alias("grade"))


@query("agg8_code_health", "SELECT l_suppkey, round(100 * (1 - (0.3 * avg(l_discount) * 4 + 0.3 * avg(l_tax) * 4 + 0.2 * 0.1 + 0.15 * 0.2 + 0.05 * 0.3)), 6) AS health FROM lineitem GROUP BY l_suppkey")
def agg8(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 4).alias("c"), (F.avg("l_tax") * 4).alias("d"))
    return g.select("l_suppkey", _r(health.code_health(F.col("c"), F.col("d"), F.lit(0.1), F.lit(0.2), F.lit(0.3))).alias("health"))


@query("agg11_chapman_coverage", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT round(((SELECT count(*) FROM a) + 1.0) * ((SELECT count(*) FROM b) + 1) / ((SELECT count(*) FROM a JOIN b USING (user_id)) + 1) - 1, 6)::DOUBLE AS estimate")
def agg11(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "view").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    n = u.agg(F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.count_if(F.col("a") & F.col("b")).alias("m"))
    return n.select(_r((F.col("a") + 1.0) * (F.col("b") + 1) / (F.col("m") + 1) - 1).alias("estimate"))


@query("agg12_stats", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def agg12(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), _r(F.avg("n_chars")).alias("mean"))


@query("agg16_report", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, round(count(*) FILTER (value > 50) / count(*), 6) AS rate FROM events WHERE ts >= (SELECT min(ts) FROM events) GROUP BY event_type")
def agg16(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), _r(F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"))


_PRECEDENCE = ("purchase", "signup", "error", "click", "view")


@query("agg17_precedence_label", f"WITH p AS (SELECT user_id, event_id, event_type, list_position([{listed(_PRECEDENCE)}], event_type) AS k FROM events) SELECT user_id, event_type AS label, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id DESC) AS r FROM p) WHERE r = 1")
def agg17(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.array_position(F.array(*[F.lit(x) for x in _PRECEDENCE]), F.col("event_type")))
    return e.groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct("k", (-F.col("event_id")).alias("e"))).alias("m")).select("user_id", F.col("m.event_type").alias("label"), "m.event_id")


@query("agg18_derive_label", "SELECT user_id, coalesce(max_by(value, event_id) FILTER (event_type = 'purchase'), max_by(value, event_id) FILTER (event_type = 'click')) AS value FROM events GROUP BY user_id")
def agg18(spark, sf):
    e = table(spark, sf, "events")
    last = lambda t: F.max_by(F.when(F.col("event_type") == t, F.col("value")), F.when(F.col("event_type") == t, F.col("event_id")))
    return e.groupBy("user_id").agg(F.coalesce(last("purchase"), last("click")).alias("value"))


@query("agg21_value_ledger", """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, value FROM events)
SELECT coalesce(day, week, month, 'lifetime') AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY GROUPING SETS ((day), (week), (month), ())""")
def agg21(spark, sf):
    """Sums by day, ISO week, month and in all, in one pass over the events."""
    e = table(spark, sf, "events").selectExpr("date_format(ts, 'yyyy-MM-dd') as day", "concat(extract(YEAROFWEEK from ts), '-W', lpad(weekofyear(ts), 2, '0')) as week", "date_format(ts, 'yyyy-MM') as month", "value")
    by = e.groupingSets([[F.col("day")], [F.col("week")], [F.col("month")], []], "day", "week", "month").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.coalesce("day", "week", "month", F.lit("lifetime")).alias("bucket"), "n", "total")


@query("agg22_trends", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY day ORDER BY day DESC LIMIT 7")
def agg22(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(7)


_PRICES = (("src", 0.5), ("src1", 1.5), ("src12", 2.0))


@query("agg23_estimate_cost", "WITH p(prefix, price) AS (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in _PRICES) + "), m AS (SELECT doc_id, n_chars, max_by(price, length(prefix)) AS price FROM documents JOIN p ON starts_with(source, prefix) GROUP BY ALL) SELECT doc_id, round(price * n_chars / 1000, 6) AS cost FROM m")
def agg23(spark, sf):
    price = None
    for a, b in sorted(_PRICES, key=lambda p: -len(p[0])):
        price = (F if price is None else price).when(F.col("source").startswith(a), b)
    return table(spark, sf, "documents").where(price.isNotNull()).select("doc_id", _r(price * F.col("n_chars") / 1000).alias("cost"))


@query("agg24_trimmed_mean", """
WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, round(avg(x), 6) AS mean FROM r WHERE n < 3 OR (i > greatest(1, n // 10) AND i <= n - greatest(1, n // 10)) GROUP BY l_suppkey""")
def agg24(spark, sf):
    return health.trimmed_mean(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice").select("l_suppkey", _r("mean").alias("mean"))


@query("agg29_contradictions", "WITH b AS (SELECT l_partkey AS entity, l_discount * 10 AS confidence FROM lineitem) SELECT a.entity, a.confidence AS low, b.confidence AS high, count(*) AS pairs FROM b a JOIN b ON a.entity = b.entity AND b.confidence - a.confidence > 0.4 GROUP BY ALL")
def agg29(spark, sf):
    return health.contradictions(table(spark, sf, "lineitem").selectExpr("l_partkey as entity", "l_discount * 10 as confidence"))


@query("agg31_coverage_gaps", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def agg31(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("agg32_welford", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM events GROUP BY event_type")
def agg32(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean"), _r(F.var_samp("value")).alias("variance"))


@query("agg33_archetype_classify", """
WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS c, k, avg(x) AS m FROM v GROUP BY label, k),
d AS (SELECT vec_id, c, sqrt(sum((x - m) * (x - m))) AS d FROM v JOIN c USING (k) GROUP BY vec_id, c), r AS (SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM d)
SELECT a.vec_id, a.c AS archetype, round((b.d - a.d) / greatest(a.d, b.d), 6) AS confidence FROM r a JOIN r b USING (vec_id) WHERE a.r = 1 AND b.r = 2""")
def agg33(spark, sf):
    return health.classify_by_centroid(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


# ---- windows ----


@query("win1_forward_overlap", r"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
g AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w), m AS (SELECT conv_id, g, max(turn) AS t FROM g GROUP BY ALL),
o AS (SELECT conv_id, turn, avg((t > turn)::INT) AS o FROM g JOIN m USING (conv_id, g) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN turn = last THEN 0.5 ELSE coalesce(o, 0) END, 6)::DOUBLE AS overlap FROM w LEFT JOIN o USING (conv_id, turn)""")
def win1(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.words_of(F.col("text")).alias("w"))
    g = c.select("conv_id", "turn", F.explode(F.array_distinct(X.ngrams(F.col("w"), 2))).alias("g"))
    later = g.groupBy("conv_id", "g").agg(F.max("turn").alias("t"))
    o = g.join(later, ["conv_id", "g"]).groupBy("conv_id", "turn").agg(F.avg((F.col("t") > F.col("turn")).cast("int")).alias("o"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.join(o, ["conv_id", "turn"], "left").join(last, "conv_id").select("conv_id", "turn", _r(F.when(F.col("turn") == F.col("last"), 0.5).otherwise(F.coalesce("o", F.lit(0.0)))).alias("overlap"))


_DEPS = "max(CASE WHEN role = 'user' THEN turn END) OVER p AS last_user, max(CASE WHEN role = 'system' THEN turn END) OVER p AS last_system"


@query("win2_infer_dependencies", f"SELECT conv_id, turn, {_DEPS} FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win2(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    last = lambda r: F.last(F.when(F.col("role") == r, F.col("turn")), ignorenulls=True).over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", last("user").alias("last_user"), last("system").alias("last_system"))


@query("win3_forward_refs", f"WITH d AS (SELECT conv_id, turn, {_DEPS} FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, last_user AS turn, count(*) AS refs FROM d WHERE last_user IS NOT NULL GROUP BY ALL")
def win3(spark, sf):
    return win2(spark, sf).where("last_user is not null").groupBy("conv_id", F.col("last_user").alias("turn")).agg(F.count("*").alias("refs"))


@query("win4_protect_recent", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS protected FROM conversations")
def win4(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))) <= 3).alias("protected"))


@query("win6_record_trace", "WITH s AS (SELECT user_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT before, event_type, count(*) AS n, round(avg(value), 6) AS outcome FROM s WHERE before IS NOT NULL GROUP BY ALL")
def win6(spark, sf):
    s = table(spark, sf, "events").withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))).where("before is not null")
    return s.groupBy("before", "event_type").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("outcome"))


@query("win8_gravity_bonus", "SELECT user_id, round(1 - exp(-2 * sum(value) / 1000), 6) AS bonus FROM events GROUP BY user_id HAVING sum(value) / 1000 > 0.005")
def win8(spark, sf):
    m = table(spark, sf, "events").groupBy("user_id").agg((F.sum("value") / 1000).alias("m"))
    return m.where("m > 0.005").select("user_id", _r(1 - F.exp(-2 * F.col("m"))).alias("bonus"))


_PAIRS = "l AS (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem), rp AS (SELECT a.p AS a, b.p AS b, count(*) AS n, round(0.1 * count(*), 6)::DOUBLE AS strength FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p < b.p GROUP BY ALL)"


@query("win14_resonance_pairs", f"WITH {_PAIRS} SELECT * FROM rp")
def win14(spark, sf):
    """Pairs chosen together; an order has at most seven items, so its pairs are few."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    a = l.select("ps", F.posexplode("ps").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), _r(0.1 * F.count("*")).alias("strength"))


@query("win17_top_pairs", f"WITH {_PAIRS} SELECT * FROM rp ORDER BY abs(strength) DESC, a, b LIMIT 10")
def win17(spark, sf):
    return win14(spark, sf).orderBy(F.desc(F.abs("strength")), "a", "b").limit(10)


@query("win15_resonance_bonus", "WITH e AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS s FROM events GROUP BY ALL) SELECT user_id, round(sum(s * (1 - 1 / (1.0 + n))) / sum(1 - 1 / (1.0 + n)), 6)::DOUBLE AS bonus FROM e GROUP BY user_id")
def win15(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("s")).withColumn("w", 1 - 1 / (1.0 + F.col("n")))
    return e.groupBy("user_id").agg(_r(F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("bonus"))


@query("win16_decay_and_prune", "WITH e AS (SELECT user_id, sum(value) / 100000 * 0.95 AS s FROM events GROUP BY user_id) SELECT user_id, round(s, 6) AS strength FROM e WHERE abs(s) >= 0.001")
def win16(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg((F.sum("value") / 100000 * 0.95).alias("s"))
    return e.where(F.abs("s") >= 0.001).select("user_id", _r("s").alias("strength"))


@query("win18_co_access", "SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM events a JOIN events b ON b.event_id BETWEEN a.event_id - 5 AND a.event_id - 1 AND a.event_type <> b.event_type GROUP BY ALL")
def win18(spark, sf):
    """Types met within five events before: a range frame within blocks of ids, each with its neighbours' margin."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    block = F.col("event_id") / 1000
    both = e.select("*", F.explode(F.array_distinct(F.array(F.floor(block), F.floor((F.col("event_id") + 5) / 1000)))).alias("block"))
    near = both.withColumn("near", F.collect_list("event_type").over(W.partitionBy("block").orderBy("event_id").rangeBetween(-5, -1))).where(F.floor(block) == F.col("block"))
    return near.select(F.col("event_type").alias("a"), F.explode("near").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("win21_percentile", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def win21(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(_r(F.percentile("value", F.lit(0.95))).alias("p95"))


@query("win22_trend", "SELECT event_type, round(regr_slope(value, event_id), 8) AS slope FROM events GROUP BY event_type")
def win22(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.regr_slope("value", F.col("event_id").cast("double")), 8).alias("slope"))


@query("win5_position_thresholds", "SELECT conv_id, turn, (CASE role WHEN 'user' THEN 1.0 WHEN 'system' THEN 0.9 ELSE 0.5 END * (0.5 + 0.5 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id)))::DOUBLE AS threshold FROM conversations")
def win5(spark, sf):
    w = W.partitionBy("conv_id")
    k = F.when(F.col("role") == "user", 1.0).when(F.col("role") == "system", 0.9).otherwise(0.5)
    return table(spark, sf, "conversations").select("conv_id", "turn", (k * (0.5 + 0.5 * F.row_number().over(w.orderBy("turn")) / F.count("*").over(w))).alias("threshold"))


# ---- the flagship: scored, ranked, selected ----


def best_context(spark, sf: str, budget: int = 8000):
    """Documents for a question under a budget: duplicates out, information and BM25 to a relevance, greedy fill."""
    docs = _docs(spark, sf)
    first = dedup.mark_duplicates(docs).where("duplicate_of is null").select("doc_id")
    ranked = retrieval.min_max(retrieval.bm25(docs, TERMS), "score")
    scored = _scored(spark, sf).join(first, "doc_id").join(ranked, "doc_id")
    relevance = X.softcap(0.5 * F.col("score") + 0.3 * F.col("information") * I.mass_factor(F.col("tokens")) + 0.2 * F.lit(0.5))
    chosen = selection.greedy_fill(scored.select("doc_id", "tokens", relevance.alias("relevance")), budget, score="relevance")
    used = F.sum("tokens").over(W.orderBy("place"))  # over at most budget rows
    return chosen.select("doc_id", "tokens", _r("relevance").alias("relevance"), used.alias("used"))


@query("flagship_best_context")
def flagship(spark, sf):
    return best_context(spark, sf)
