"""Queries on the order of a context and on what fills it: the turns of every conversation, for its last turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import information as I
from ..functions import text as X
from ..operators import channel, selection
from .registry import query, rounded, table
from .samples import PATHS, pick, sql_pick
from .scalars import _criticality_sql

#: A turn's words of so many letters are symbols; the first turn that has one defines it.
SYMBOL, BUDGET = 6, 220
_WORD = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BOOST = "CASE c WHEN 'safety' THEN 3.0 WHEN 'critical' THEN 2.0 WHEN 'important' THEN 1.5 ELSE 1.0 END"
_TURNS = f"""
t AS (SELECT conv_id, turn, text, list_distinct({_WORD}) AS w FROM conversations), l AS (SELECT conv_id, arg_max(w, turn) AS q FROM t GROUP BY conv_id),
p AS (SELECT conv_id, turn, text, lower({sql_pick(PATHS, '(conv_id + turn)')}) AS p, greatest(1, octet_length(encode(text)) // 4) AS tokens,
 round(len(list_intersect(w, q)) / greatest(1, len(q)), 6)::DOUBLE AS relevance FROM t JOIN l USING (conv_id)),
f AS (SELECT *, round(relevance * {_BOOST}, 6)::DOUBLE AS importance FROM (SELECT *, {_criticality_sql()} AS c FROM p)),
s AS (SELECT conv_id, turn, word FROM (SELECT conv_id, turn, unnest(w) AS word FROM t) WHERE length(word) >= {SYMBOL}), d AS (SELECT conv_id, word, min(turn) AS src FROM s GROUP BY ALL),
e AS (SELECT DISTINCT conv_id, src, turn AS dst FROM s JOIN d USING (conv_id, word) WHERE turn > src)"""
_LEVELS = f"""WITH RECURSIVE {_TURNS},
v AS (SELECT conv_id, turn, 0 AS level FROM f UNION SELECT e.conv_id, e.dst, level + 1 FROM v JOIN e ON e.conv_id = v.conv_id AND e.src = v.turn),
lv AS (SELECT conv_id, turn, max(level)::INT AS level FROM v GROUP BY ALL),
m AS (SELECT *, level > 0 AND level = max(level) OVER (PARTITION BY conv_id) AS leaf FROM f JOIN lv USING (conv_id, turn)),
o AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY leaf, level, CASE WHEN leaf THEN importance ELSE -importance END, CASE WHEN leaf THEN -turn ELSE turn END) - 1)::INT AS place FROM m)"""


def turns(spark, sf):
    """Turns as fragments: tokens, path, how many words of the conversation's last turn they have, and whether they define a symbol."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.array_distinct(X.words_of(F.col("text"))).alias("w"))
    last = t.groupBy("conv_id").agg(F.max_by("w", "turn").alias("q"))
    f = t.join(last, "conv_id").withColumn("path", pick(PATHS, F.col("conv_id") + F.col("turn")))
    relevance = rounded(F.size(F.array_intersect("w", "q")) / F.greatest(F.lit(1), F.size("q")), 6)
    f = f.select("conv_id", "turn", "text", "path", X.token_count(F.col("text")).alias("tokens"), relevance.alias("relevance"))
    return f.withColumn("importance", rounded(channel.importance(F.col("relevance"), F.col("path")), 6))


def symbols(spark, sf):
    """(definitions (conv_id, word, src), edges (conv_id, src, dst)): from the turn that first has a word to the others that have it."""
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(X.words_of(F.col("text")))).alias("word")).where(F.length("word") >= SYMBOL)
    first = words.groupBy("conv_id", "word").agg(F.min("turn").alias("src"))
    return first, words.join(first, ["conv_id", "word"]).where("turn > src").select("conv_id", "src", F.col("turn").alias("dst")).distinct()


def _levelled(spark, sf):
    f = turns(spark, sf)
    return f.join(channel.levels(f, symbols(spark, sf)[1], "conv_id", "turn"), ["conv_id", "turn"])


@query("sel20_topological_levels", _LEVELS + " SELECT conv_id, turn, level FROM o")
def sel20_levels(spark, sf):
    return channel.levels(turns(spark, sf), symbols(spark, sf)[1], "conv_id", "turn")


@query("sel20_semantic_interleave", _LEVELS + " SELECT conv_id, turn, level, importance, place FROM o")
def sel20(spark, sf):
    """Definitions first, what refers to them behind, and the most important of the last level at the end."""
    return channel.interleave(_levelled(spark, sf), "conv_id", "turn", "importance").select("conv_id", "turn", "level", "importance", "place")


@query("sel21_bookend_calibrate", _LEVELS + """,
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, count(*) OVER (PARTITION BY conv_id, level) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY level, place) - 1 AS spot FROM o),
a AS (SELECT *, round(CASE WHEN n <= 1 THEN 1.0 ELSE 0.4 * exp(-spot / greatest(0.15 * n, 1.0)) + 0.4 * exp(-(n - 1 - spot) / greatest(0.15 * n, 1.0)) + 0.2 END, 12) AS seen FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, level ORDER BY relevance DESC, place) AS rank, row_number() OVER (PARTITION BY conv_id, level ORDER BY seen DESC, spot) AS nth FROM a)
SELECT x.conv_id, x.turn, CASE WHEN x.size <= 2 THEN x.spot ELSE y.spot END::INT AS slot FROM r x JOIN r y ON x.conv_id = y.conv_id AND x.level = y.level AND x.rank = y.nth""")
def sel21(spark, sf):
    """The places of sel20 set anew within each level: the most relevant where attention is highest."""
    placed = channel.interleave(_levelled(spark, sf), "conv_id", "turn", "importance")
    return channel.bookend(placed, "conv_id", "relevance").select("conv_id", "turn", "slot")


_CHOSEN = f"""WITH RECURSIVE {_TURNS},
k AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY relevance DESC, turn) AS used FROM f), c AS (SELECT * FROM k WHERE used <= {BUDGET}),
room AS (SELECT conv_id, {BUDGET} - coalesce(sum(tokens) FILTER (used <= {BUDGET}), 0)::BIGINT AS room FROM k GROUP BY conv_id),
x AS (SELECT f.* FROM f ANTI JOIN c ON f.conv_id = c.conv_id AND f.turn = c.turn JOIN room ON f.conv_id = room.conv_id WHERE room > 0 AND tokens <= room),
hx AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM f),
gr AS (SELECT conv_id, turn, substr(h, (2 * i - 1)::BIGINT, 6) AS gram, count(*) AS n FROM (SELECT conv_id, turn, h, unnest(range(1, length(h) // 2 - 1)) AS i FROM hx) GROUP BY ALL),
cov AS (SELECT DISTINCT conv_id, gram FROM gr SEMI JOIN c ON gr.conv_id = c.conv_id AND gr.turn = c.turn),
sh AS (SELECT gr.conv_id, gr.turn, sum(n) AS total, coalesce(sum(n) FILTER (cov.gram IS NOT NULL), 0) AS met FROM gr LEFT JOIN cov ON gr.conv_id = cov.conv_id AND gr.gram = cov.gram GROUP BY ALL),
bs AS (SELECT conv_id, turn, unnest(regexp_extract_all(h, '..')) AS byte FROM hx), bc AS (SELECT conv_id, turn, byte, count(*) AS n FROM bs GROUP BY ALL), bt AS (SELECT conv_id, turn, sum(n) AS total FROM bc GROUP BY ALL),
en AS (SELECT conv_id, turn, round(least(-sum((n / total) * log2(n / total)) / 6, 1.0), 6) AS entropy FROM bc JOIN bt USING (conv_id, turn) GROUP BY ALL),
gain AS (SELECT conv_id, turn, tokens, entropy * (1.0 - coalesce(met / total, 0.0)) * CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.conv_id = x.conv_id AND d.src = x.turn) THEN 1.5 ELSE 1.0 END AS gain
 FROM x JOIN en USING (conv_id, turn) LEFT JOIN sh USING (conv_id, turn))"""


def _gap(spark, sf):
    """(fragments, chosen, room): the most relevant turns within the budget, and the tokens that they leave."""
    first, _ = symbols(spark, sf)
    f = turns(spark, sf).join(first.select("conv_id", F.col("src").alias("turn"), F.lit(True).alias("_d")).distinct(), ["conv_id", "turn"], "left")
    f = f.withColumn("defines", F.coalesce("_d", F.lit(False))).withColumn("entropy", F.round(I.normalized_entropy(I.shannon_entropy("text")), 6)).drop("_d")
    chosen = selection.ranked_fill(f, "conv_id", BUDGET, [F.desc("relevance"), F.asc("turn")])
    used = chosen.groupBy("conv_id").agg(F.sum("tokens").alias("used"))
    room = f.select("conv_id").distinct().join(used, "conv_id", "left").select("conv_id", (F.lit(BUDGET) - F.coalesce("used", F.lit(0))).alias("room"))
    return f, chosen, room


@query("sel18_marginal_gain", _CHOSEN + " SELECT conv_id, turn, round(gain, 10)::DOUBLE AS gain FROM gain")
def sel18(spark, sf):
    f, chosen, room = _gap(spark, sf)
    rest = f.join(chosen.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").join(room, "conv_id").where("room > 0 and tokens <= room")
    picked = f.join(chosen.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return channel.marginal_gain(rest, picked, "conv_id", "turn", "text", "entropy", "defines").select("conv_id", "turn", F.round("gain", 10).alias("gain"))


@query("sel17_trailing_pass", _CHOSEN + """,
z AS (SELECT conv_id, turn, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY round(gain / tokens, 12) DESC, turn) AS r FROM gain),
w AS (SELECT conv_id, 0::BIGINT AS r, room AS rest, false AS took FROM room WHERE room > 0
 UNION ALL SELECT w.conv_id, z.r, rest - CASE WHEN tokens <= rest THEN tokens ELSE 0 END, tokens <= rest FROM w JOIN z ON z.conv_id = w.conv_id AND z.r = w.r + 1)
SELECT conv_id, turn, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY r)::INT AS place FROM w JOIN z USING (conv_id, r) WHERE took""")
def sel17(spark, sf):
    """What of the turns that were not chosen is shown beside them, in the room that is left."""
    return channel.trailing_pass(*_gap(spark, sf), "conv_id", "turn")
