"""Queries over one document or question at a time: information, words, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import information as I
from ..functions import text as X
from .registry import query, table
from .samples import PATHS, QUESTIONS, listed, pick, quoted, sql_any, sql_pick

_W = r"[\p{L}\p{N}_]+"
#: Byte histograms by document: n bytes, entropies h1 and h2.
BYTES = """
b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
h AS (SELECT doc_id, -sum((n / total) * log2(n / total)) AS h1, -log2(sum((n / total) * (n / total))) AS h2 FROM c JOIN t USING (doc_id) GROUP BY doc_id),
e AS (SELECT doc_id, text, coalesce(h1, 0.0) AS h1, coalesce(h2, 0.0) AS h2 FROM documents LEFT JOIN h USING (doc_id))"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _entropies(spark, sf):
    return _docs(spark, sf).withColumn("h1", I.shannon_entropy("text")).withColumn("h2", I.renyi_entropy_2("text"))


def _r(x):
    return F.round(x, 6)


def _entropy_query(name, column, expression, sql):
    @query(name, f"WITH {BYTES} SELECT doc_id, round({sql}, 6) AS {column} FROM e")
    def run(spark, sf):
        return _entropies(spark, sf).select("doc_id", _r(expression(F.col("h1"), F.col("h2"))).alias(column))


_entropy_query("inf1_shannon_entropy", "entropy", lambda h1, h2: h1, "h1")
_entropy_query("inf2_normalized_entropy", "entropy", lambda h1, h2: I.normalized_entropy(h1), "least(h1 / 6, 1.0)")
_entropy_query("inf3_renyi_entropy_2", "entropy", lambda h1, h2: h2, "h2")
_entropy_query("inf6_entropy_divergence", "divergence", I.entropy_divergence, "greatest(h1 - h2, 0.0)")
_entropy_query("inf10_bits_per_byte", "bpb", lambda h1, h2: I.bits_per_byte(h1), "greatest(0.0, least(1.0, h1 / 8))")
_entropy_query("inf11_bpb_quality", "quality", lambda h1, h2: I.bpb_quality(I.bits_per_byte(h1), F.least(h2 / 10, F.lit(1.0))), "greatest(0.0, least(1.0, 0.6 * greatest(0.0, least(1.0, h1 / 8)) + 0.4 * (1 - least(h2 / 10, 1.0))))")


@query("inf4_renyi_entropy_alpha", """
WITH v AS (SELECT o_orderpriority AS grp, o_totalprice AS x FROM orders WHERE o_totalprice > 0), s AS (SELECT grp, sum(x) AS total, max(x) AS top FROM v GROUP BY grp)
SELECT grp, round(log2(sum(pow(x / total, 2.0))) / -1.0, 6) AS a2, round(log2(sum(pow(x / total, 0.5))) / 0.5, 6) AS a05, round(-sum(x / total * log2(x / total)), 6) AS a1, round(-log2(max(x / total)), 6) AS ainf
FROM v JOIN s USING (grp) GROUP BY grp""")
def inf4(spark, sf):
    """Entropies of a grouped measure by sums, without an array for each group."""
    v = table(spark, sf, "orders").where("o_totalprice > 0").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"))
    p = F.col("x") / F.col("total")
    return v.join(F.broadcast(v.groupBy("grp").agg(F.sum("x").alias("total"))), "grp").groupBy("grp").agg(
        _r(F.log2(F.sum(F.pow(p, F.lit(2.0)))) / -1.0).alias("a2"), _r(F.log2(F.sum(F.pow(p, F.lit(0.5)))) / 0.5).alias("a05"), _r(-F.sum(p * F.log2(p))).alias("a1"), _r(-F.log2(F.max(p))).alias("ainf")
    )


@query("set11_renyi_alpha_of_arrays", """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM v WHERE x > 0)
SELECT vec_id, round(-log2(sum(p * p)), 6) AS a2, round(-sum(p * log2(p)), 6) AS a1, round(-log2(max(p)), 6) AS ainf FROM p GROUP BY vec_id""")
def set11(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", _r(I.renyi_alpha(F.col("v"), 2)).alias("a2"), _r(I.renyi_alpha(F.col("v"), 1)).alias("a1"), _r(I.renyi_alpha(F.col("v"), 1000)).alias("ainf"))


@query("inf5_renyi_max", "SELECT doc_id, round(CASE WHEN n_chars > 1 THEN log2(n_chars) ELSE 0.0 END, 6) AS top FROM documents")
def inf5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _r(F.when(F.col("n_chars") > 1, F.log2("n_chars")).otherwise(0.0)).alias("top"))


@query("inf7_kolmogorov_entropy")
def inf7(spark, sf):
    return _docs(spark, sf).select("doc_id", _r(I.kolmogorov_entropy(F.col("text"))).alias("entropy"))


@query("inf8_compressed_size")
def inf8(spark, sf):
    return _docs(spark, sf).select("doc_id", I.compressed_size("text").alias("size"))


@query("inf9_ncd_similarity")
def inf9(spark, sf):
    """Each assistant turn against the user turn before it."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.where("before is not null").select("conv_id", "turn", _r(I.ncd_similarity("text", "before")).alias("similarity"))


_TRIMMED = r"list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '')"


def _sql_boilerplate(x: str) -> str:
    return f"({x} = '' OR {x} IN ({listed(C.BOILERPLATE_LINES)}) OR {sql_any('starts_with', x, C.BOILERPLATE_STARTS)} OR (starts_with({x}, 'def __') AND contains({x}, '__(')) OR (starts_with({x}, 'package ') AND NOT contains({x}, '{{')))"


BOILER = f"CASE WHEN len({_TRIMMED}) = 0 THEN 1.0 ELSE len(list_filter({_TRIMMED}, lambda b: {_sql_boilerplate('b')})) / len({_TRIMMED}) END"


@query("inf12_boilerplate_ratio", f"WITH d AS (SELECT doc_id, 'import x' || chr(10) || text || chr(10) || '  }}' AS text FROM documents) SELECT doc_id, round({BOILER}, 6) AS ratio FROM d")
def inf12(spark, sf):
    d = _docs(spark, sf).withColumn("text", F.concat(F.lit("import x\n"), "text", F.lit("\n  }")))
    return d.select("doc_id", _r(X.boilerplate_ratio(F.col("text"))).alias("ratio"))


@query("inf13_is_boilerplate", f"SELECT event_type, props, {_sql_boilerplate('props')} AS boilerplate, count(*) AS n FROM events GROUP BY ALL")
def inf13(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", "props", X.is_boilerplate(F.col("props")).alias("boilerplate")).agg(F.count("*").alias("n"))


_LOW_PATH = f"lower({sql_pick(PATHS, 'doc_id')})"
_WEIGHT = "CASE " + " ".join(f"WHEN {sql_any('ends_with', _LOW_PATH, ends)}{' OR contains(' + _LOW_PATH + ', ' + quoted('dockerfile') + ')' if w == 0.40 else ''} THEN {w}" for w, ends in C.SOURCE_WEIGHTS) + f" ELSE {C.OTHER_SOURCE_WEIGHT} END"


def _paths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"))


@query("inf18_source_type_multiplier", f"SELECT doc_id, ({_WEIGHT})::DOUBLE AS weight FROM documents")
def inf18(spark, sf):
    return _paths(spark, sf).select("doc_id", X.source_weight(F.col("path")).alias("weight"))


@query("inf19_information_mass_factor", "SELECT doc_id, greatest(1, octet_length(encode(text)) // 4) AS tokens, round(0.3 + 0.7 / (1 + exp(-ln(greatest(1, octet_length(encode(text)) // 4) / 80))), 6) AS factor FROM documents")
def inf19(spark, sf):
    t = _docs(spark, sf).select("doc_id", X.token_count(F.col("text")).alias("tokens"))
    return t.withColumn("factor", _r(I.mass_factor(F.col("tokens"))))


@query("inf20_calibrated_token_count", "SELECT doc_id, greatest(1, floor(length(text) / CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 3.6 WHEN 'fr' THEN 3.8 ELSE 3.7 END))::BIGINT AS tokens FROM documents")
def inf20(spark, sf):
    ratio = F.when(F.col("lang") == "en", 4.0).when(F.col("lang") == "de", 3.6).when(F.col("lang") == "fr", 3.8).otherwise(3.7)
    return table(spark, sf, "documents").select("doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / ratio)).cast("long").alias("tokens"))


@query("inf24_compute_relevance", "WITH s AS (SELECT user_id, count(*)::DOUBLE / 20 AS freq, avg(value) / 100 AS sem, 0.5 AS rec FROM events GROUP BY user_id) SELECT user_id, round(0.85 * tanh((0.3 * rec + 0.25 * freq + 0.25 * sem + 0.2 * least(sem, 1)) / 0.85), 6) AS relevance FROM s")
def inf24(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg((F.count("*") / 20).alias("freq"), (F.avg("value") / 100).alias("sem"))
    raw = 0.3 * F.lit(0.5) + 0.25 * F.col("freq") + 0.25 * F.col("sem") + 0.2 * F.least("sem", F.lit(1.0))
    return s.select("user_id", _r(X.softcap(raw)).alias("relevance"))


@query("inf25_softcap", "SELECT event_id, round(0.85 * tanh(value / 100 / 0.85), 6) AS capped, round(least(value / 100, 1.0), 6) AS cut FROM events")
def inf25(spark, sf):
    x = F.col("value") / 100
    return table(spark, sf, "events").select("event_id", _r(X.softcap(x)).alias("capped"), _r(X.softcap(x, 0)).alias("cut"))


@query("inf26_ebbinghaus_decay", "SELECT conv_id, turn, round(exp(-ln(2) / greatest(4, 1) * greatest(max(turn) OVER (PARTITION BY conv_id) - turn, 0)), 6) AS recency FROM conversations")
def inf26(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.expr("max(turn) over (partition by conv_id) - turn").alias("age"))
    return c.select("conv_id", "turn", _r(I.ebbinghaus(F.col("age"), F.lit(4))).alias("recency"))


@query("inf27_checkpoint_decay", "SELECT conv_id, turn, round(exp(-0.01 * turn), 6) AS recency FROM conversations")
def inf27(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", _r(F.exp(-0.01 * F.col("turn"))).alias("recency"))


def _words_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{_W}')"


_CODE = f"list_filter({_words_sql('text')}, lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({listed(C.CODE_STOP_WORDS)}))"
_TERMS = f"list_filter({_words_sql('q')}, lambda w: octet_length(encode(w)) >= 2 AND w NOT IN ({listed(C.STOP_WORDS)}))"


@query("str1_tokenize_code", f"SELECT doc_id, len({_CODE})::BIGINT AS n, md5(array_to_string({_CODE}, ' ')) AS terms FROM documents")
def str1(spark, sf):
    d = _docs(spark, sf).withColumn("t", X.code_terms(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


@query("str2_tokenize_path", f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({_LOW_PATH}, '[/\\\\.\\-_]'), lambda p: length(p) >= 2 AND p NOT IN ({listed(C.PATH_STOP_WORDS)})), ' ') AS terms FROM documents")
def str2(spark, sf):
    return _paths(spark, sf).select("doc_id", F.array_join(X.path_terms(F.col("path")), " ").alias("terms"))


@query("str3_split_identifier", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(p_brand || 'HTTPServer_parseURL' || p_partkey, '([^A-Z_])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '_+'), lambda p: p <> ''), ' ') AS parts FROM part")
def str3(spark, sf):
    name = F.concat("p_brand", F.lit("HTTPServer_parseURL"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.split_identifier(name), " ").alias("parts"))


@query("str5_extract_identifiers", f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_W}'), lambda w: octet_length(encode(w)) > 1))::BIGINT AS n FROM documents")
def str5(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(F.filter(F.regexp_extract_all("text", F.lit(_W), F.lit(0)), lambda w: F.octet_length(w) > 1)).cast("long").alias("n"))


@query("str13_tokenize_query", f"WITH d AS (SELECT doc_id, {sql_pick(QUESTIONS, 'doc_id')} AS q FROM documents) SELECT doc_id, array_to_string({_TERMS}, ' ') AS terms FROM d")
def str13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.query_terms(pick(QUESTIONS, F.col("doc_id"))), " ").alias("terms"))


@query("str14_term_frequency", f"WITH d AS (SELECT doc_id, text AS q FROM documents), t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM d), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id) SELECT doc_id, term, round(count(*) / any_value(n.n), 6) AS tf FROM t JOIN n USING (doc_id) GROUP BY doc_id, term")
def str14(spark, sf):
    terms = _docs(spark, sf).select("doc_id", X.query_terms(F.col("text")).alias("t"))
    return terms.select("doc_id", F.size("t").alias("n"), F.explode("t").alias("term")).groupBy("doc_id", "term", "n").count().select("doc_id", "term", _r(F.col("count") / F.col("n")).alias("tf"))


@query("str15_idf", f"WITH d AS (SELECT doc_id, text AS q FROM documents), t AS (SELECT DISTINCT doc_id, unnest({_TERMS}) AS term FROM d) SELECT term, round(ln((SELECT count(*) FROM documents) / (1 + count(*))) + 1, 6) AS idf FROM t GROUP BY term")
def str15(spark, sf):
    docs = _docs(spark, sf)
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(X.query_terms(F.col("text")))).alias("term")).groupBy("term").count()
    return df.crossJoin(F.broadcast(n)).select("term", _r(F.log(F.col("n") / (1 + F.col("count"))) + 1).alias("idf"))


@query("str17_word_trigrams", """
WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))::BIGINT AS n FROM w""")
def str17(spark, sf):
    words = F.filter(F.transform(X.spaced_words(F.lower("text")), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda x: x != "")
    c = table(spark, sf, "conversations").withColumn("w", words)
    return c.select("conv_id", "turn", F.size(F.array_distinct(X.ngrams(F.col("w"), 3))).cast("long").alias("n"))


@query("str18_split_sentences", "SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')) AS sentence FROM conversations")
def str18(spark, sf):
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" \n"))), lambda s: s != "")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(parts).alias("sentence"))


@query("str22_long_sentences", "WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM conversations) SELECT conv_id, turn, count(*) AS n FROM s WHERE length(trim(s)) >= 20 GROUP BY ALL")
def str22(spark, sf):
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+|\n+", "$1\x01"), "\x01")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(parts).alias("s")).where(F.length(F.trim("s")) >= 20).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("str23_wiki_links", "SELECT doc_id, array_to_string(regexp_extract_all('see [[' || source || ']] and [[' || lang || '|x]] ' || 'no [link]', '\\[\\[([^\\]|]+)', 1), ',') AS links FROM documents")
def str23(spark, sf):
    text = F.concat(F.lit("see [["), "source", F.lit("]] and [["), "lang", F.lit("|x]] no [link]"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), F.lit(1)), ",").alias("links"))


@query("str28_content_words", f"WITH d AS (SELECT conv_id, turn, text AS q FROM conversations) SELECT conv_id, turn, len(list_distinct({_TERMS}))::BIGINT AS n FROM d")
def str28(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.array_distinct(X.query_terms(F.col("text")))).cast("long").alias("n"))


@query("str29_extract_numbers", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), ',') AS numbers FROM documents")
def str29(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), ",").alias("numbers"))


@query("str30_extract_entities", "SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)*')))::BIGINT AS n FROM conversations")
def str30(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"), F.lit(0)))).cast("long").alias("n"))


@query("str31_normalize_text", "SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS norm FROM conversations")
def str31(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))).alias("norm"))


@query("str49_directory_of", f"SELECT doc_id, regexp_extract({sql_pick(PATHS, 'doc_id')}, '^(.*)/[^/]*$', 1) AS directory, length({sql_pick(PATHS, 'doc_id')}) - length(replace({sql_pick(PATHS, 'doc_id')}, '/', '')) AS depth FROM documents")
def str49(spark, sf):
    return _paths(spark, sf).select("doc_id", X.directory_of(F.col("path")).alias("directory"), X.path_depth(F.col("path")).cast("long").alias("depth"))


def _criticality_sql() -> str:
    p = "p"
    base = "regexp_extract(p, '[^/]*$')"
    root = "(length(replace(p, 'file:', '')) - length(replace(replace(p, 'file:', ''), '/', '')) <= 1)"
    by = f"CASE WHEN {root} THEN 'critical' ELSE 'important' END"
    return f"""CASE WHEN {base} IN ({listed(C.SAFETY_FILES)}) THEN 'safety' WHEN {base} IN ({listed(C.CONFIG_FILES)}) THEN {by}
 WHEN {base} IN ({listed(C.TYPE_FILES)}) OR {sql_any('ends_with', base, C.TYPE_ENDS)} THEN 'important' WHEN {sql_any('ends_with', p, C.INFRASTRUCTURE_ENDS)} THEN {by}
 WHEN starts_with({base}, 'test_') OR {sql_any('ends_with', base, C.TEST_ENDS)} OR {sql_any('contains', base, C.CONTRACT_WORDS)} THEN 'important' ELSE 'normal' END"""


@query("flt1_file_criticality", f"WITH d AS (SELECT doc_id, {_LOW_PATH} AS p FROM documents) SELECT doc_id, {_criticality_sql()} AS criticality FROM d")
def flt1(spark, sf):
    return _paths(spark, sf).select("doc_id", X.criticality(F.col("path")).alias("criticality"))


@query("flt2_has_safety_signal", """
WITH d AS (SELECT doc_id, lower(text) AS t, list_transform(string_split(lower(text), chr(10)), lambda l: regexp_replace(l, '^\\s+', '')) AS ls FROM documents)
SELECT doc_id, contains(t, '-----begin private key-----') OR contains(t, '-----begin rsa private key-----') OR contains(t, 'aws_secret_access_key') OR
 len(list_filter(ls, lambda l: NOT (starts_with(l, '#') OR starts_with(l, '//') OR starts_with(l, '/*') OR starts_with(l, '*') OR starts_with(l, '-') OR starts_with(l, repeat(chr(34), 3)) OR starts_with(l, repeat(chr(39), 3))) AND contains(l, '=') AND (contains(l, 'secret_key') OR contains(l, 'api_key') OR contains(l, 'private_key')))) > 0 AS signal FROM d""")
def flt2(spark, sf):
    return _docs(spark, sf).select("doc_id", X.has_safety_signal(F.col("text")).alias("signal"))


_TASK = "CASE " + " ".join(f"WHEN {sql_any('contains', 'lower(q)', parts)} THEN {quoted(n)}" for n, _, parts in C.TASKS) + " ELSE 'unknown' END"
_FACTOR = "CASE t " + " ".join(f"WHEN {quoted(n)} THEN {f}" for n, f, _ in C.TASKS) + " ELSE 1.0 END"


@query("flt3_task_type", f"WITH d AS (SELECT doc_id, {sql_pick(QUESTIONS, 'doc_id')} AS q FROM documents), k AS (SELECT doc_id, {_TASK} AS t FROM d) SELECT doc_id, t AS task, ({_FACTOR})::DOUBLE AS factor FROM k")
def flt3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.task_type(pick(QUESTIONS, F.col("doc_id"))).alias("task"))
    return d.withColumn("factor", X.budget_multiplier(F.col("task")))


_VAGUE = f"""
WITH d AS (SELECT doc_id, {sql_pick(QUESTIONS, 'doc_id')} AS q FROM documents), t AS (SELECT doc_id, q, {_TERMS} AS ts FROM d),
s AS (SELECT doc_id, len(ts) AS n, len(list_filter(ts, lambda w: {sql_any('contains', 'w', C.GENERIC_VERBS)})) AS g, len(list_filter(ts, lambda w: {sql_any('contains', 'w', C.SPECIFIC_WORDS)})) AS s,
 len(list_filter(string_split_regex(q, ' +'), lambda w: octet_length(encode(w)) > 4 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[^A-Z]'))) > 0 AS named FROM t),
v AS (SELECT doc_id, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE floor(greatest(0, least(1, g::DOUBLE / n * 0.5::DOUBLE + (CASE WHEN n < 3 THEN 0.7 WHEN n < 5 THEN 0.4 WHEN n < 7 THEN 0.15 ELSE 0 END)::DOUBLE * 0.3::DOUBLE - least(s * 0.15::DOUBLE + CASE WHEN named THEN 0.2::DOUBLE ELSE 0 END, 0.4::DOUBLE) * 0.7::DOUBLE)) * 1000 + 0.5) / 1000 END AS vagueness FROM s)"""


@query("flt5_vagueness", _VAGUE + " SELECT doc_id, vagueness FROM v")
def flt5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.vagueness(pick(QUESTIONS, F.col("doc_id"))).alias("vagueness"))


@query("flt6_analyze_query", _VAGUE + " SELECT doc_id, vagueness, vagueness >= 0.45 AS needs_refinement FROM v")
def flt6(spark, sf):
    return flt5(spark, sf).withColumn("needs_refinement", F.col("vagueness") >= 0.45)


@query("flt8_classify_block", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool_result' ELSE CASE WHEN contains(text, '```') THEN 'assistant_code' ELSE 'assistant' END END AS kind FROM conversations")
def flt8(spark, sf):
    r = F.col("role")
    kind = F.when(r == "user", "user").when(r == "system", "system").when(r == "tool", "tool_result").when(F.col("text").contains("```"), "assistant_code").otherwise("assistant")
    return table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query("sel28_token_budget", f"WITH d AS (SELECT doc_id, {sql_pick(QUESTIONS, 'doc_id')} AS q FROM documents), k AS (SELECT doc_id, {_TASK} AS t FROM d) SELECT doc_id, floor(128000 * 0.15::DOUBLE * least(1.0, {_FACTOR})::DOUBLE)::BIGINT AS budget FROM k")
def sel28(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.budget_multiplier(X.task_type(pick(QUESTIONS, F.col("doc_id")))).alias("f"))
    return d.select("doc_id", F.floor(128000 * F.lit(0.15) * F.least(F.lit(1.0), "f")).cast("long").alias("budget"))


@query("sel29_dynamic_budget", _VAGUE + " SELECT doc_id, round(greatest(500, least(102400, 0.15 * 128000 * (0.5 + 1.5 / (1 + exp(-3 * (vagueness - 0.5)))) * least(2.0, 0.5 + 400 / 200))), 6)::DOUBLE AS budget FROM v")
def sel29(spark, sf):
    b = 0.15 * 128000 * (0.5 + 1.5 / (1 + F.exp(-3 * (F.col("vagueness") - 0.5)))) * F.least(F.lit(2.0), F.lit(0.5 + 400 / 200))
    return flt5(spark, sf).select("doc_id", _r(F.greatest(F.lit(500.0), F.least(F.lit(102400.0), b))).alias("budget"))


@query("sel19_attention_weight", "SELECT conv_id, turn, round(0.4 * exp(-p / greatest(0.15 * l, 1)) + 0.4 * exp(-(l - 1 - p) / greatest(0.15 * l, 1)) + 0.2, 6)::DOUBLE AS weight FROM (SELECT conv_id, turn, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS l FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def sel19(spark, sf):
    c = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "row_number() over (partition by conv_id order by turn) - 1 as p", "count(*) over (partition by conv_id) as l")
    tau = F.greatest(0.15 * F.col("l"), F.lit(1.0))
    return c.select("conv_id", "turn", _r(0.4 * F.exp(-F.col("p") / tau) + 0.4 * F.exp(-(F.col("l") - 1 - F.col("p")) / tau) + 0.2).alias("weight"))


