"""Builds a context pack for every question of a table: the best documents that fit its budget of tokens.

    python -m jobs.context_packs --source /data/documents.parquet --questions /data/benchmark.parquet --out /data/packs

Copies are left out by their words, all documents are ranked for all questions by BM25, and each question's
best candidates are taken in order as long as they fit. The packs, texts included, are written in partitions
of questions; a run replaces what stands there, so it may be repeated at any time with the same result.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from siftwork.functions.text import token_count
from siftwork.operators.dedup import content_hash
from siftwork.operators.retrieval import bm25_many
from siftwork.operators.selection import first_fit
from siftwork.plans.relational import _CODE, _NORM
from siftwork.sources.shared import new_path, written

from .common import command, defaults

log = logging.getLogger("jobs.context_packs")

#: Picked rows up to which they are broadcast to the documents, whose texts then stay where they are.
BROADCAST_PICKS = 500_000


def build_packs(spark: SparkSession, config: dict) -> DataFrame:
    """Writes the packs of config["questions"] over config["source"] to config["out"], and returns them.

    Rows (item, place, key, source, tokens, used, score, text). Of documents with the same words the one of the
    smallest key is a candidate; null texts and null keys are none. Scores count to six places and ties go to
    the smaller key. A question that no document shares a term with has no pack.
    """
    began, key, item = time.time(), config["key"], config["item"]
    docs = spark.read.parquet(config["source"]).select(F.col(key).alias("key"), F.col(config["text"]).alias("text"), "source").where("key is not null and text is not null")
    questions = spark.read.parquet(config["questions"]).select(F.col(config["item"]).alias("item"), F.col(config["question"]).alias("question"))
    first = docs.groupBy(content_hash(F.col("text")).alias("content")).agg(F.min("key").alias("key"))
    distinct = written(docs.join(first, "key", "left_semi"), "packs-distinct")  # read twice, and its shuffle is not repeated
    log.info("read %d different documents of %s and %d questions of %s", distinct.count(), config["source"], questions.count(), config["questions"])
    scores = bm25_many(distinct, questions, "key", "text", "item", "question").withColumn("score", F.round("score", 6))
    sizes = distinct.select(F.col("key").alias("of"), token_count(F.col("text")).alias("tokens"))
    best = first_best(scores, config["candidates"]).join(sizes, F.col("key") == F.col("of"))
    packs = written(first_fit(best, "item", config["budget"], [F.desc("score"), F.asc("key")], ["key", "tokens", "score"], config["candidates"]), "packs-picks")
    picks = packs.count()
    few = F.broadcast(packs) if picks <= BROADCAST_PICKS else packs
    out = distinct.join(few, "key").select(F.col("item").alias(item), "place", F.col("key").alias(key), "source", "tokens", "used", "score", "text")
    out = out.withColumn("part", F.pmod(F.xxhash64(item), F.lit(config["parts"])).cast("int"))
    out.repartition(config["parts"], "part").sortWithinPartitions("part", item, "place").write.mode("overwrite").partitionBy("part").parquet(config["out"])
    back = spark.read.schema(out.schema).parquet(config["out"]).drop("part")
    log.info("wrote %d documents in packs of %d questions to %s, in %.1f s", picks, packs.select("item").distinct().count(), config["out"], time.time() - began)
    return back


def first_best(scores: DataFrame, candidates: int) -> DataFrame:
    """The best rows of each question, before sizes and texts are joined to them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("key")))
    return scores.withColumn("_place", place).where(F.col("_place") <= candidates).select("item", "key", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job run twice over the documents and the benchmark's items, into one new folder."""
    config = defaults("context_packs") | {"source": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/benchmark.parquet", "out": new_path(spark, "job2-context-packs")}
    build_packs(spark, config)
    return build_packs(spark, config)


_VALUES = defaults("context_packs")
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, {_NORM} AS content FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, source, text, greatest(1, octet_length(encode(text)) // 4) AS tokens FROM d WHERE doc_id IN (SELECT min(doc_id) FROM d GROUP BY content)),
k AS (SELECT doc_id, {_CODE} AS t FROM u), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM k), x AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM k),
q AS (SELECT DISTINCT item_id, unnest({_CODE}) AS term FROM benchmark), qn AS (SELECT item_id, count(*) AS wanted FROM q GROUP BY item_id),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT item_id, doc_id, count(*) AS matched, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / greatest(a, 1)))) AS base FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(base + pow(matched / wanted, 1.5) * 0.5 * base, 6) AS score FROM bm JOIN qn USING (item_id)),
c AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc QUALIFY r <= {_VALUES["candidates"]}),
f AS (SELECT DISTINCT item_id, 0::BIGINT AS r, 0::BIGINT AS used, false AS took FROM c
 UNION ALL SELECT f.item_id, c.r, used + CASE WHEN used + tokens <= {_VALUES["budget"]} THEN tokens ELSE 0 END, used + tokens <= {_VALUES["budget"]} FROM f JOIN c ON c.item_id = f.item_id AND c.r = f.r + 1 JOIN u ON u.doc_id = c.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY r)::INT AS place, doc_id, source, tokens, used, score, text FROM f JOIN c USING (item_id, r) JOIN u USING (doc_id) WHERE took"""


if __name__ == "__main__":
    command("context_packs", build_packs)
