"""Queries on answers and their claims, tool outputs, conversations, and the engine as a whole."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..engine import Engine, register_all
from ..functions import claims, compress, distill, tool_output
from ..operators import conversation
from .fragments import FRAGMENTS
from .registry import query, table
from .relational import TERMS
from .samples import PATHS, code, pick, quoted, sql_code
from .scalars import BYTES, _criticality_sql


def _r(x):
    return F.round(x, 6)


def _answers(spark, sf):
    """What an assistant says, with the turn before it."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.where("role = 'assistant' and before is not null").select("conv_id", "turn", "before", "text")


# ---- claims; held against examples and plain versions in the tests ----


def certificates(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", F.explode(claims.certificates("before", "text")).alias("c")).select("conv_id", "turn", "c.*")


@query("wit1_analyze")
def wit1(spark, sf):
    """Each answer's score: one less the mean risk of its claims."""
    return certificates(spark, sf).groupBy("conv_id", "turn").agg(F.count("*").alias("claims"), _r(1 - F.avg("risk")).alias("score"), F.count_if(F.col("label") == "grounded").alias("grounded"), F.count_if(F.col("label") == "contradicted").alias("contradicted"))


@query("wit6_certify_claim")
def wit6(spark, sf):
    return certificates(spark, sf).select("conv_id", "turn", "place", "label", "support", "contradiction", "risk")


@query("wit4_evidence_windows")
def wit4(spark, sf):
    """How adequate the best windows of the turn before are for each claim."""
    return certificates(spark, sf).select("conv_id", "turn", "place", F.md5("claim").alias("claim"), "adequacy")


@query("wit9_slot_support")
def wit9(spark, sf):
    return certificates(spark, sf).select("conv_id", "turn", "place", "support", "adequacy")


@query("wit2_analyze_with_policy")
def wit2(spark, sf):
    """Answers without the claims that the policy takes out."""
    return _answers(spark, sf).select("conv_id", "turn", F.md5(claims.strict("before", "text")).alias("strict"))


@query("wit5_apply_policy")
def wit5(spark, sf):
    """Answers with the claims marked that the policy would take out."""
    return _answers(spark, sf).select("conv_id", "turn", F.md5(claims.annotated("before", "text")).alias("annotated"))


@query("wit16_aggregate")
def wit16(spark, sf):
    """The risk of an answer: one less the product of what each claim leaves."""
    c = certificates(spark, sf)
    return c.groupBy("conv_id", "turn").agg(_r(1 - F.exp(F.sum(F.log1p(-F.col("risk"))))).alias("risk"))


@query("flt22_classify_claim")
def flt22(spark, sf):
    return certificates(spark, sf).groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"))


@query("wit15_decompose")
def wit15(spark, sf):
    return certificates(spark, sf).select("conv_id", "turn", "place", F.md5("claim").alias("claim"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s|\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {_TRIM})), lambda s: s <> '')"


@query("str26_split_sentences", f"SELECT conv_id, turn, len({_SENTENCES})::BIGINT AS n, md5(array_to_string({_SENTENCES}, chr(1))) AS sentences FROM conversations")
def str26(spark, sf):
    s = claims.sentence_spans("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.md5(F.array_join(F.transform(s, lambda x: x["text"]), "\x01")).alias("sentences"))


@query("str27_sentence_windows")
def str27(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(claims.context_windows("text")).alias("place", "w")).select("doc_id", "place", F.length("w").alias("size"))


@query("str32_longest_substring")
def str32(spark, sf):
    """The share of an answer that the longest run in common with the turn before covers, by a suffix automaton."""
    return _answers(spark, sf).select("conv_id", "turn", _r(claims.longest_share("text", "before")).alias("share"))


# ---- answers and conversations ----

_BARE = "trim(l, ' ' || chr(9) || chr(13))"


def _filler_sql(upto: int | None = None) -> str:
    out = _BARE
    for pattern, instead in distill.FILLER[:upto]:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(instead)}, 'gi')"
    return f"trim({out}, ' ' || chr(9) || chr(13))"


_SAMPLES = ("Sure! ", "I think ", "In order to win, ", "Got it. ", "It is important to note that ", "Let me know if you have questions. ", "")
_TALK = f"tk AS (SELECT conv_id, turn, ([{', '.join(quoted(s) for s in _SAMPLES)}])[(conv_id + turn) % {len(_SAMPLES)} + 1] || text AS text FROM conversations)"


def _talk(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(pick(_SAMPLES, F.col("conv_id") + F.col("turn")), "text").alias("text"))


def _distill_sql(upto: int | None = None) -> str:
    short = _filler_sql(upto)
    kept = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN {_BARE} = '' THEN '' WHEN regexp_matches({_BARE}, {quoted(distill.EMPTY_LINES)}, 'i') OR {short} = '' THEN NULL ELSE regexp_extract(l, '^[ \\t]*') || {short} END), lambda l: l IS NOT NULL)"
    return f"CASE WHEN length(text) < 50 THEN text ELSE trim(regexp_replace(array_to_string({kept}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10)) END"


@query("conv32_distill_response", f"WITH {_TALK} SELECT conv_id, turn, md5({_distill_sql()}) AS short FROM tk")
def conv32(spark, sf):
    return _talk(spark, sf).select("conv_id", "turn", F.md5(distill.distilled(F.col("text"))).alias("short"))


@query("conv33_distill_chunk", f"WITH {_TALK} SELECT conv_id, turn, md5({_distill_sql(4)}) AS short FROM tk")
def conv33(spark, sf):
    """Each chunk by itself, by a streaming query without state."""
    from ..streaming import bus
    from .outside import _folder

    c = table(spark, sf, "conversations")
    stream = bus.read_events(spark, f"{sf}/conversations.parque[t]", c.schema)
    talk = stream.select("conv_id", "turn", F.concat(pick(_SAMPLES, F.col("conv_id") + F.col("turn")), "text").alias("text"))
    return bus.run_to_end(talk.select("conv_id", "turn", F.md5(distill.distilled(F.col("text"), "lite")).alias("short")), _folder(spark))


_SENT = "list_filter(regexp_split_to_array(text, '[.\\n]'), lambda s: octet_length(encode(trim(s))) > 5)"


@query("conv5_compress_block", f"""WITH b AS (SELECT conv_id, turn, role, text, {_SENT} AS s FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN text = '' THEN '[empty ' || role || ']' WHEN role <> 'assistant' THEN text WHEN len(s) <= 3 THEN left(text, 300) ELSE trim(s[1]) || '. ' || trim(s[2]) || '. [...] ' || trim(s[len(s)]) END) AS skeleton,
 CASE WHEN text = '' THEN '[empty ' || role || ']' ELSE '[' || role || ': ' || left(string_split(text, chr(10))[1], 60) || '...]' END AS digest FROM b""")
def conv5(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(conversation.block_skeleton(F.col("role"), F.col("text"))).alias("skeleton"), conversation.block_digest(F.col("role"), F.col("text")).alias("digest"))


def _by_conversation(spark, sf, f):
    """f of the roles and texts of each conversation, in order."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        short = f(pdf["role"].tolist(), pdf["text"].tolist())
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "before": pdf["text"].str.len(), "after": [len(x) for x in short]})

    return table(spark, sf, "conversations").groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, before long, after long")


@query("conv8_entropic_prune")
def conv8(spark, sf):
    return _by_conversation(spark, sf, tool_output.prune_turns)


@query("conv13_compress_messages")
def conv13(spark, sf):
    """Each conversation brought towards 600 tokens, its last two messages whole."""
    return _by_conversation(spark, sf, lambda roles, texts: tool_output.fit_messages(roles, texts, 600, 2))


@query("conv14_compress_all_messages")
def conv14(spark, sf):
    """Budgets that the last messages alone are over: all but the last question are shortened."""
    return _by_conversation(spark, sf, lambda roles, texts: tool_output.fit_messages(roles, texts, 60))


conv_skeleton, conv_digest = compress.arrow(tool_output.skeleton), compress.arrow(tool_output.digest)


@query("conv9_skeletonize")
def conv9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(conv_skeleton("text")).alias("after"))


@query("conv10_summarize")
def conv10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(conv_digest("text")).alias("after"))


# ---- tool outputs: each user's events, printed as a tool would ----

def _line(kind: str):
    """What a tool prints for an event."""
    is_error = F.col("event_type") == "error"
    lines = {
        "test": lambda: F.when(is_error, F.concat(F.lit("test t"), "event_id", F.lit(" ... FAILED\n    at line "), "user_id")).otherwise(F.concat(F.lit("test t"), "event_id", F.lit(" ... ok"))),
        "git_diff": lambda: F.when(is_error, F.concat(F.lit("@@ -"), "event_id", F.lit(" @@\n-old\n+new"))).otherwise(F.concat(F.lit(" context "), "event_id")),
        "git_log": lambda: F.concat(F.lit("commit "), F.md5(F.col("event_id").cast("string")), F.lit("\nAuthor: u"), "user_id", F.lit("\n\n    "), "event_type", F.lit(" number "), "event_id", F.lit("\n")),
        "git_status": lambda: F.concat(F.when(is_error, "\tdeleted:    ").otherwise("\tmodified:   "), F.lit("f"), "event_id", F.lit(".py")),
        "listing": lambda: F.concat(F.when(F.col("event_type") == "view", "drwxr-xr-x").otherwise("-rw-r--r--"), F.lit(" 1 root root "), "event_id", F.lit(" Jan 1 10:00 n"), "event_id"),
        "build": lambda: F.when(is_error, F.concat(F.lit("error: e"), "event_id", F.lit("\n   | here"))).otherwise(F.concat(F.lit("compiling c"), "event_id")),
        "log": lambda: F.concat(F.lit("2024-01-01 10:00:00 "), "event_type", F.lit(" happened")),
    }
    return lines[kind]()


_TOOLS = ("test", "git_diff", "git_log", "git_status", "listing", "build", "log")
_FIRST = {"test": "running 60 tests\n", "git_diff": "diff --git a/x b/x\n", "git_status": "On branch main\nChanges not staged:\n  (use git add)\n"}


def printed(spark, sf, kind: str):
    rows = F.array_sort(F.collect_list(F.struct("event_id", _line(kind).alias("line"))))
    text = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    return table(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit(_FIRST.get(kind, "")), text).alias("t"))


@pandas_udf(T.StringType())
def _short(texts):
    return texts.map(lambda t: tool_output.compress_tool_output(t)[0])


@pandas_udf(T.StringType())
def _kind(texts):
    return texts.map(lambda t: tool_output.compress_tool_output(t)[1])


def _tool_query(name: str, kind: str):
    @query(name)
    def run(spark, sf):
        return printed(spark, sf, kind).select("user_id", F.length("t").alias("before"), F.length(_short("t")).alias("after"), F.md5(_short("t")).alias("digest"))


for _name, _of in (("conv24_test_output", "test"), ("conv25_git_diff", "git_diff"), ("conv26_git_status", "git_status"), ("conv28_directory_listing", "listing"), ("conv29_build_errors", "build"), ("conv30_log_output", "log")):
    _tool_query(_name, _of)


@query("conv27_git_log", "SELECT user_id, md5(string_agg(left(md5(event_id::VARCHAR), 7) || ' ' || event_type || ' number ' || event_id, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def conv27(spark, sf):
    return printed(spark, sf, "git_log").select("user_id", F.md5(_short("t")).alias("digest"))


@query("conv23_compress_tool_output")
def conv23(spark, sf):
    """The kind that each tool's output is taken for."""
    every = None
    for kind in _TOOLS:
        one = printed(spark, sf, kind).select("user_id", F.lit(kind).alias("tool"), _kind("t").alias("kind"))
        every = one if every is None else every.unionByName(one)
    return every


@query("conv31_json_blob")
def conv31(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "props")))
    t = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(rows).alias("t"))
    return t.select("user_id", _kind("t").alias("kind"), F.length(_short("t")).alias("after"))


@query("conv19_compress_csv", "WITH r AS (SELECT user_id, event_id, event_id || ',' || event_type || ',' || value AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, md5('id,type,value' || chr(10) || string_agg(line, chr(10) ORDER BY event_id) FILTER (k <= 5) || CASE WHEN max(n) > 5 THEN chr(10) || '[... ' || (max(n) - 5) || ' more rows, 3 columns]' ELSE '' END) AS digest FROM r GROUP BY user_id")
def conv19(spark, sf):
    line = F.concat_ws(",", "event_id", "event_type", F.col("value").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    t = table(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("id,type,value\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("t"))
    return t.select("user_id", F.md5(compress.compress_csv("t")).alias("digest"))


@query("conv16_compress_markdown")
def conv16(spark, sf):
    t = F.concat(F.lit("# "), "source", F.lit("\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), F.lit("\n## "), "lang", F.lit("\nend\n"))
    return table(spark, sf, "documents").select("doc_id", F.length(compress.compress_markdown(t)).alias("after"))


@query("conv17_compress_email")
def conv17(spark, sf):
    """Each conversation as a thread of mails."""
    mail = F.concat(F.lit("From: "), "role", F.lit("\nSubject: turn "), "turn", F.lit("\n\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", mail.alias("m")))).alias("ms"))
    t = F.array_join(F.transform("ms", lambda x: x["m"]), "\n")
    return c.select("conv_id", F.length(t).alias("before"), F.length(compress.compress_email(t)).alias("after"))


@query("conv18_compress_stacktrace", "WITH f AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, md5('Traceback' || chr(10) || string_agg('  at ' || event_type || '.run(f.py:' || first || ')', chr(10) ORDER BY first) || CASE WHEN count(*) FILTER (n > 1) > 0 THEN chr(10) || '  [' || count(*) FILTER (n > 1) || ' repeated frames deduplicated]' ELSE '' END) AS digest FROM f GROUP BY user_id")
def conv18(spark, sf):
    """Frames of each user's events, told apart by their types."""
    line = F.concat(F.lit("  at "), "event_type", F.lit(".run(f.py:"), "event_id", F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    # a type called error would be a line about a fault
    e = table(spark, sf, "events").groupBy("user_id").agg(F.concat(F.lit("Traceback\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("t"))
    return e.select("user_id", F.md5(compress.compress_stacktrace("t")).alias("digest"))


@query("conv22_compress_table", "WITH r AS (SELECT user_id, event_id, '| ' || event_id || ' | ' || event_type || ' |' AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, md5(string_agg(line, chr(10) ORDER BY event_id) FILTER (k <= CASE WHEN n <= 6 THEN 6 ELSE 5 END) || CASE WHEN max(n) > 6 THEN chr(10) || '| ... ' || (max(n) - 5) || ' more rows ... |' ELSE '' END) AS digest FROM r GROUP BY user_id")
def conv22(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("| "), "event_id", F.lit(" | "), "event_type", F.lit(" |")).alias("line"))))
    t = table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("t"))
    return t.select("user_id", F.md5(compress.compress_table("t")).alias("digest"))


@query("conv37_original_store", "SELECT conv_id, turn, md5(text) AS handle, text FROM conversations WHERE length(text) >= 500")
def conv37(spark, sf):
    """What was compressed, found again by the handle of its original."""
    c = table(spark, sf, "conversations").where("length(text) >= 500").select("conv_id", "turn", F.md5("text").alias("handle"), "text")
    originals = c.select("handle", "text").groupBy("handle").agg(F.min("text").alias("text"))
    return c.select("conv_id", "turn", "handle").join(originals, "handle").select("conv_id", "turn", "handle", "text")


short_argument = compress.arrow(tool_output.shorten_json_argument)


@query("set9_shorten_argument")
def set9(spark, sf):
    t = F.to_json(F.struct("conv_id", "role", "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length(t).alias("before"), F.length(short_argument(t)).alias("after"))


# ---- the engine ----


def engine(spark, sf) -> Engine:
    d = table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"), "text")
    return Engine(d, table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"))


_HASH = "md5(array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ' '))"


@query("sel23_optimize", f"""
WITH RECURSIVE {FRAGMENTS}, hs AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_HASH}), cr AS (SELECT *, {_criticality_sql()} IN ('safety', 'critical') AS pinned FROM (SELECT *, lower(path) AS p FROM sc JOIN hs USING (doc_id)) AS x),
o AS (SELECT *, row_number() OVER (PARTITION BY pinned ORDER BY score / tokens DESC, doc_id) AS r FROM cr),
g AS (SELECT 0::BIGINT AS r, 4000::BIGINT AS room, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens UNION ALL SELECT o.r, CASE WHEN o.tokens <= g.room THEN g.room - o.tokens ELSE g.room END, CASE WHEN o.tokens <= g.room THEN o.doc_id END, o.tokens FROM g JOIN o ON o.pinned AND o.r = g.r + 1),
us2 AS (SELECT coalesce(sum(tokens) FILTER (doc_id IS NOT NULL), 0)::BIGINT AS used FROM g),
k AS (SELECT 0::BIGINT AS r, (SELECT 8000 - used FROM us2)::BIGINT AS room, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens UNION ALL SELECT o.r, CASE WHEN o.tokens <= k.room THEN k.room - o.tokens ELSE k.room END, CASE WHEN o.tokens <= k.room THEN o.doc_id END, o.tokens FROM k JOIN o ON NOT o.pinned AND o.r = k.r + 1)
SELECT doc_id, tokens, true AS pinned FROM g WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, tokens, false FROM k WHERE doc_id IS NOT NULL""")
def sel23(spark, sf):
    """The whole way from fragments to context: features, copies out, pinned files, greedy fill."""
    return engine(spark, sf).optimize(TERMS, 8000).select("doc_id", "tokens", "pinned")


@query("src9_ingest", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_HASH}")
def src9(spark, sf):
    """Fragments taken in twice: copies are left out."""
    e = engine(spark, sf)
    return e.ingest(e.docs.limit(0)).docs.select("doc_id")


@query("src16_export_fragments", "SELECT doc_id, length(text) AS n FROM documents")
def src16(spark, sf):
    state = engine(spark, sf).export()
    return state.select("doc_id", F.length(F.get_json_object("state", "$.text")).cast("long").alias("n"))


@query("api1_stats", "SELECT (SELECT count(*) FROM documents) AS fragments, (SELECT sum(greatest(1, octet_length(encode(text)) // 4))::BIGINT FROM documents) AS tokens, 29::BIGINT AS paths, (SELECT count(*) FROM events) AS events")
def api1(spark, sf):
    return engine(spark, sf).stats()


@query("src13_load_index", "SELECT doc_id, md5(text) AS digest FROM documents")
def src13(spark, sf):
    """An engine saved and loaded again."""
    from .outside import _folder

    e = engine(spark, sf)
    folder = e.save(f"{_folder(spark)}/engine-{spark.sparkContext.startTime}-{id(e)}")
    return Engine.load(spark, folder, "doc_id long, path string, text string", "user_id long, event_id long, event_type string, value double").docs.select("doc_id", F.md5("text").alias("digest"))


@query("api2_sql_functions", f"WITH {BYTES} SELECT doc_id, greatest(1, octet_length(encode(text)) // 4) AS tokens, round(h1, 6) AS h1, round(h2, 6) AS h2, round(greatest(0.0, least(1.0, h1 / 8)), 6)::DOUBLE AS bpb FROM e")
def api2(spark, sf):
    """The library's functions from SQL."""
    register_all(spark)
    d = table(spark, sf, "documents")
    h = d.selectExpr("doc_id", "siftwork_token_count(text) as tokens", "siftwork_shannon_entropy(text) as h1", "siftwork_renyi_entropy_2(text) as h2")
    return h.selectExpr("doc_id", "tokens", "round(h1, 6) as h1", "round(h2, 6) as h2", "round(siftwork_bits_per_byte(h1), 6) as bpb")


@query("api17_review_diff", f"WITH {sql_code()}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS n FROM code) SELECT doc_id, n, CASE WHEN contains(line, 'unwrap()') OR contains(line, 'unsafe') THEN 'risk' WHEN regexp_matches(line, 'TODO|FIXME') THEN 'todo' WHEN contains(line, 'eval(') THEN 'danger' END AS finding FROM l WHERE contains(line, 'unwrap()') OR contains(line, 'unsafe') OR regexp_matches(line, 'TODO|FIXME') OR contains(line, 'eval(')")
def api17(spark, sf):
    """Findings on the lines that a change would add."""
    l = code(table(spark, sf, "documents")).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    x = F.col("line")
    finding = F.when(x.contains("unwrap()") | x.contains("unsafe"), "risk").when(x.rlike("TODO|FIXME"), "todo").when(x.contains("eval("), "danger")
    return l.select("doc_id", (F.col("n") + 1).alias("n"), finding.alias("finding")).where("finding is not null")
