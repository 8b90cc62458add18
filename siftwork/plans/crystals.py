"""Queries on what is watched: families of questions in the stream of outcomes, and an index that follows a feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import knowledge
from ..sources import files
from ..sources.shared import new_path
from ..streaming import crystals, watch
from .knowledge import beliefs
from .registry import query, table
from .samples import PATHS, QUESTIONS, pick, sql_pick

KINDS = ("click", "purchase", "error", "signup", "view")


def outcomes(events):
    """Events as outcomes of questions: ten users are a team, a type of event stands for a question and its files, errors are worth nothing."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).cast("long")
    reward = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "purchase", F.least(F.lit(1.0), 0.6 + F.col("value") / 100)).otherwise(F.col("value") / 400)
    return events.select(
        F.floor(F.col("user_id") / 10).alias("team"), F.col("event_id").alias("at"), pick(QUESTIONS, kind).alias("question"), F.concat(F.lit("f"), kind, F.lit(".py,g"), kind % 2, F.lit(".py")).alias("fragments"), F.coalesce(reward, F.lit(0.0)).alias("reward"), F.lit(0.3).alias("baseline"),
    )


@query("lrn19_crystallize")
def lrn19(spark, sf):
    """Events of families that are answered surely better than the rest of their team, by a stateful stream; held against a fold in the tests."""
    before = {k: spark.conf.get(k, None) for k in crystals.STATE}
    for k, v in crystals.STATE.items():
        spark.conf.set(k, v)
    try:
        schema = table(spark, sf, "events").schema
        stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern, so that one file will do
        found, place = crystals.crystallize(outcomes(stream), "team", "at"), new_path(spark, "crystals")
        found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    rows = spark.read.schema(found.schema).parquet(f"{place}/out")
    return rows.select("team", "family", "at", "n", *[F.round(c, 6).alias(c) for c in ("mean", "bound", "baseline", "effect")], "recipe")


def _feed(spark, sf, place: str):
    """[a part of a feed]: most documents; the rest and changed ones; deletions, and some that come back."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source", F.lit("put").alias("op"))
    changed = d.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" (changed)")))
    return [d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0").unionByName(changed.where("doc_id % 5 = 1 and doc_id % 3 <> 0")), changed.where("doc_id % 7 = 0 and doc_id % 2 = 1").unionByName(d.where("doc_id % 7 = 0 and doc_id % 2 = 0").withColumn("op", F.lit("delete")))]


_STATE = """n AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 1 OR doc_id % 5 = 1 AND doc_id % 3 <> 0 THEN coalesce(text, '') || ' (changed)' ELSE text END AS text FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 2 = 0))"""


def watched(spark, sf):
    """An index over three parts of a feed, each written when the one before was taken in, and the whole run once more."""
    place = new_path(spark, "watch")
    columns = {"source": F.col("source"), "digest": F.md5(F.coalesce("text", F.lit(""))), "tokens": X.token_count(F.coalesce("text", F.lit("")))}
    for part in _feed(spark, sf, place):
        part.write.mode("append").parquet(f"{place}/feed")
        w = watch.Watch(spark, f"{place}/feed", f"{place}/out", columns, deleted="op = 'delete'", buckets=8)
        w.follow()
    w.follow()
    return w


@query("src8_incremental_watcher", f"WITH {_STATE} SELECT doc_id, source, md5(coalesce(text, '')) AS digest, greatest(1, octet_length(encode(coalesce(text, ''))) // 4) AS tokens FROM n")
def src8(spark, sf):
    """The index of a feed of documents after puts, changes and deletions, as one build of what is left would have it."""
    return watched(spark, sf).index()


@query("stm15_change_listener", f"WITH {_STATE} SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN 'orphaned' WHEN md5(coalesce(n.text, '')) = md5(coalesce(d.text, '')) THEN 'fresh' ELSE 'stale' END AS standing FROM documents d LEFT JOIN n USING (doc_id)")
def stm15(spark, sf):
    """What was made of every document as it first came, and whether the index still bears it out."""
    made = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("seen"))
    return watch.standing(made, watched(spark, sf).index(), "doc_id", "seen", "digest").select("doc_id", "standing")


_DOC = "'# Title ' || doc_id || chr(10) || 'intro' || chr(10) || '## Part ' || lang || chr(10) || text || chr(10) || '### More' || chr(10)"


@query("src35_compile_docs", rf"""WITH p AS (SELECT doc_id, {sql_pick(PATHS, 'doc_id')} AS path, CASE WHEN doc_id % 4 = 0 THEN text ELSE {_DOC} END AS t FROM documents), k AS (SELECT *, regexp_extract(path, '([^/]*)\.[^./]*$', 1) AS stem FROM p WHERE ends_with(lower(path), '.md')),
d AS (SELECT * FROM k WHERE (NOT contains(path, '/') AND regexp_matches(upper(stem), '^({'|'.join(files.DOC_NAMES)})')) OR regexp_matches(lower(path), '^({'|'.join(files.DOC_FOLDERS)})/')), l AS (SELECT *, string_split(t, chr(10)) AS ls FROM d WHERE trim(t) <> '')
SELECT doc_id, 'doc/' || lower(stem) AS entity, coalesce(trim(substr(list_filter(ls, lambda x: starts_with(x, '# '))[1], 3)), lower(stem)) AS title, len(list_filter(ls, lambda x: starts_with(x, '## ') OR starts_with(x, '### ')))::INT AS sections, len(regexp_extract_all(t, '\S+'))::INT AS words FROM l""")
def src35(spark, sf):
    """Beliefs of the documents that describe a project: title, sections and words."""
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("# Title "), "doc_id", F.lit("\nintro\n## Part "), "lang", F.lit("\n"), "text", F.lit("\n### More\n")))
    made = files.compile_docs(d.select("doc_id", pick(PATHS, F.col("doc_id")).alias("path"), text.alias("t")), "path", "t")
    return made.select("doc_id", "entity", "title", F.size("sections").alias("sections"), "words")


@query("join23_inject_beliefs", "WITH bl AS (SELECT d.doc_id, 'doc' || d.doc_id AS entity, CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'refuted' ELSE 'inferred' END AS status, round(least(1.0, length(text) / 4000.0), 6) AS confidence, text FROM documents d JOIN labels USING (doc_id)) SELECT entity, 'vault://beliefs/' || entity || '#' || substr(md5(entity), 1, 8) AS source, greatest(1, length(text) // 4)::BIGINT AS tokens, (confidence >= 0.85) AS pinned, md5(text) AS body FROM bl WHERE confidence >= 0.6 AND status NOT IN ('stale', 'retracted', 'refuted')")
def join23(spark, sf):
    """All sure beliefs as fragments: where they come from, their size, and whether they are pinned."""
    b = beliefs(spark, sf).where("confidence >= 0.6 and status not in ('stale', 'retracted', 'refuted')")
    return knowledge.as_fragments(b, "entity", "confidence", "text").select("entity", "source", "tokens", "pinned", F.md5("text").alias("body"))
