"""Queries on sources and sinks, evidence, security and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import witness
from ..sources import files
from ..sources.shared import shared_dir as _folder
from ..streaming import bus
from .registry import query, table
from .samples import PATHS, pick, quoted, sql_pick

_P = f"SELECT doc_id, {sql_pick(PATHS, 'doc_id')} AS path FROM documents"


def _r(x):
    return F.round(x, 6)


def _paths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"))


_ENDS = " OR ".join(f"ends_with(b, {quoted(e)})" for e in files.INDEXED)


@query("src6_should_index", f"WITH p AS ({_P}), b AS (SELECT doc_id, lower(regexp_extract(path, '[^/]*$')) AS b FROM p) SELECT doc_id, {_ENDS} OR b IN ('dockerfile', 'makefile') AS indexed FROM b")
def src6(spark, sf):
    return _paths(spark, sf).select("doc_id", files.should_index(F.col("path")).alias("indexed"))


@query("src5_matches_ignore", f"WITH p AS ({_P}) SELECT doc_id, path FROM p WHERE NOT (regexp_matches(path, '(^|/)tests($|/)') OR regexp_matches(path, '(^|/)[^/]*\\.md($|/)'))")
def src5(spark, sf):
    return _paths(spark, sf).where(~files.ignored(F.col("path"), ("tests/", "*.md")))


def _within(names) -> str:
    return "(" + " OR ".join(f"contains(p, '/{n}/')" for n in names) + ")"


@query("src7_priority_score", f"WITH d AS ({_P}), l AS (SELECT doc_id, '/' || lower(path) AS p FROM d) SELECT doc_id, (CASE WHEN {_within(files.COLD)} THEN 5 WHEN contains(p, 'test') THEN 40 WHEN {_within(files.HOT)} THEN 90 WHEN ends_with(p, '.md') THEN 30 ELSE 60 END)::INT AS priority FROM l")
def src7(spark, sf):
    return _paths(spark, sf).select("doc_id", files.priority(F.col("path")).alias("priority"))


@query("src14_export_state", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS state FROM nation")
def src14(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("state"))


@query("src15_import_state", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src15(spark, sf):
    state = src14(spark, sf).select("n_nationkey", F.from_json("state", "n_name string, n_regionkey int").alias("s"))
    return state.select("n_nationkey", "s.n_name", "s.n_regionkey")


@query("src21_prune_checkpoints", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r > 10")
def src21(spark, sf):
    return files.newest(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", 10).select("event_id")


@query("src22_event_log", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def src22(spark, sf):
    """Rows appended to a JSON-lines log, with broken lines among them, and read back."""
    folder = f"{_folder(spark)}/log-{id(spark)}-{spark.sparkContext.startTime}"
    rows = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", "event_type")
    rows.write.mode("overwrite").json(folder)
    spark.range(3).select(F.lit("{broken").alias("value")).write.mode("append").text(folder)
    return files.read_log(spark, folder, rows.schema).where("event_id is not null")


@query("src27_snapshot_diff", "WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id, md5(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'de') SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h")
def src27(spark, sf):
    """Two snapshots of the documents, by hashes of whole texts: which were added, deleted or changed."""
    d = table(spark, sf, "documents")
    o = d.where("lang <> 'fr'").select("doc_id", F.md5("text").alias("hash"))
    n = d.where("lang <> 'de'").select("doc_id", F.md5(F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return files.snapshot_diff(o, n, "doc_id")


@query("src28_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def src28(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("src29_ingest_diagram", "SELECT s_suppkey, 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst FROM supplier UNION ALL SELECT s_suppkey, 'N' || s_nationkey, 'World' FROM supplier")
def src29(spark, sf):
    text = F.concat(F.lit("graph TD\n  S"), "s_suppkey", F.lit(" --> N"), "s_nationkey", F.lit("\n  N"), "s_nationkey", F.lit(" -->|in| World"))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(files.diagram_edges(text)).alias("e")).select("s_suppkey", "e.src", "e.dst")


@query("src30_ingest_voice", "WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM conversations) SELECT conv_id, turn, count(*) FILTER (ends_with(trim(s), '?')) AS questions, count(*) FILTER (regexp_matches(lower(s), 'decid|agreed|will use')) AS decisions, count(*) AS n FROM s GROUP BY ALL")
def src30(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01")).alias("s"))
    return s.groupBy("conv_id", "turn").agg(F.count_if(F.trim("s").endswith("?")).alias("questions"), F.count_if(F.lower("s").rlike("decid|agreed|will use")).alias("decisions"), F.count("*").alias("n"))


@query("src31_ingest_diff", "SELECT p_partkey, 1::BIGINT AS hunk, 2::BIGINT AS added, 1::BIGINT AS removed FROM part UNION ALL SELECT p_partkey, 2, (p_size % 2)::BIGINT, 0 FROM part")
def src31(spark, sf):
    head = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n-old\n+"), "p_name", F.lit("\n+new\n same\n@@ -9 +9 @@\n ctx"))
    text = F.when(F.col("p_size") % 2 == 1, F.concat(head, F.lit("\n+odd"))).otherwise(head)
    return files.diff_counts(table(spark, sf, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


@query("set10_frontmatter", "SELECT n_nationkey, n_name AS entity, 'r' || n_regionkey AS status FROM nation")
def set10(spark, sf):
    note = F.concat(F.lit("---\nentity: "), "n_name", F.lit("\nstatus: r"), "n_regionkey", F.lit("\n---\nbody\nentity: other\n"))
    return table(spark, sf, "nation").select("n_nationkey", files.frontmatter(note, "entity").alias("entity"), files.frontmatter(note, "status").alias("status"))


# ---- evidence and security ----


@query("wit1_check_claims")
def wit1(spark, sf):
    return witness.check_conversations(table(spark, sf, "conversations")).select("conv_id", "turn", "place", _r("support").alias("support"), "verdict", _r("risk").alias("risk"))


@query("wit1_answer_scores")
def wit1_scores(spark, sf):
    return witness.answer_scores(witness.check_conversations(table(spark, sf, "conversations"))).select("conv_id", "turn", _r("score").alias("score"), "claims")


@query("wit3_extract_claims", "WITH s AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn, unnest(p) AS c FROM s) SELECT conv_id, turn, md5(trim(c)) AS claim, count(*) AS n FROM u WHERE length(trim(c)) >= 20 AND NOT ends_with(trim(c), '?') GROUP BY ALL")
def wit3(spark, sf):
    c = witness.claims(table(spark, sf, "conversations").where("role = 'assistant'"))
    return c.groupBy("conv_id", "turn", F.md5("claim").alias("claim")).agg(F.count("*").alias("n"))


# ---- streams ----


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # a pattern, so that one file will do as well as a folder
    return bus.read_events(spark, f"{sf}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stm_stream_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm_windows(spark, sf):
    """The hourly counts by a streaming query over event time."""
    out = bus.run_to_end(bus.windowed(_stream(spark, sf), late="3650 days"), _folder(spark), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stm_stream_spikes", "WITH s AS (SELECT user_id, event_id, value, count(*) OVER p AS n, avg(value) OVER p AS m, stddev_samp(value) OVER p AS sd FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, value, coalesce(n >= 3 AND sd > 0 AND value > m + 2 * sd, false) AS spike FROM s")
def stm_spikes(spark, sf):
    """Spikes of each user's values, by a stateful streaming query."""
    return bus.run_to_end(bus.spikes(_stream(spark, sf), k=2.0), _folder(spark))


@query("stm_stream_dedup", "SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY ALL")
def stm_dedup(spark, sf):
    """Each type of event of a user once, by a streaming query."""
    out = bus.run_to_end(bus.without_repeats(_stream(spark, sf), ["event_type", "user_id"], "3650 days"), _folder(spark))
    return out.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
