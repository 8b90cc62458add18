"""One object for a session: fragments in, context out, and what is learnt from how it fared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import claims, compress, information
from .functions.text import token_count
from .operators import dedup, fragments, retrieval, sast, selection
from .sources import files
from .sources.shared import written

#: SQL functions of one text, as expressions and as Arrow functions.
EXPRESSIONS = {
    "siftwork_token_count": ("t STRING", "BIGINT", "greatest(1L, CAST(floor(octet_length(t) / 4) AS BIGINT))"),
    "siftwork_hamming": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "siftwork_entropy_divergence": ("h1 DOUBLE, h2 DOUBLE", "DOUBLE", "greatest(h1 - h2, 0.0D)"),
    "siftwork_bits_per_byte": ("h1 DOUBLE", "DOUBLE", "greatest(0.0D, least(1.0D, h1 / 8))"),
    "siftwork_mass_sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
}
FUNCTIONS = {
    "siftwork_shannon_entropy": information.shannon_entropy, "siftwork_renyi_entropy_2": information.renyi_entropy_2, "siftwork_compressed_size": information.compressed_size, "siftwork_summary": compress.summary_of,
    "siftwork_json_schema": compress.schema_of, "siftwork_windows": claims.context_windows, "siftwork_certificates": claims.certificates,
}


def register_all(spark: SparkSession) -> list[str]:
    """Makes the library's scalar functions known to SQL; their names."""
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted([*EXPRESSIONS, *FUNCTIONS])


class Engine:
    """Fragments (doc_id, path, text) and the log of their use (user_id, event_id, event_type, value).

    Every method returns a DataFrame over all fragments; nothing is kept but the two tables, so an engine can be
    saved, loaded and fed from several jobs.
    """

    def __init__(self, docs: DataFrame, events: DataFrame):
        self.docs, self.events, self.spark = docs, events, docs.sparkSession

    def ingest(self, more: DataFrame) -> Engine:
        """An engine with more fragments; those whose text is there already are left out."""
        both = self.docs.select("doc_id", "path", "text").unionByName(more.select("doc_id", "path", "text"))
        first = dedup.mark_duplicates(both.select("doc_id", "text")).where("duplicate_of is null").select("doc_id")
        return Engine(both.join(first, "doc_id", "left_semi"), self.events)

    def record(self, events: DataFrame) -> Engine:
        """An engine that has learnt from more events."""
        return Engine(self.docs, self.events.unionByName(events))

    def scored(self, terms: list[str]) -> DataFrame:
        return fragments.features(self.docs, self.events, terms).withColumn("score", fragments.linear_score())

    def optimize(self, terms: list[str], budget: int, pinned_share: float = 0.5) -> DataFrame:
        """The context for a question: pinned files in part of the budget, then the best others, copies left out."""
        first = dedup.mark_duplicates(self.docs.select("doc_id", "text")).where("duplicate_of is null").select("doc_id")
        rows = written(self.scored(terms).join(first, "doc_id", "left_semi").select("doc_id", "path", "tokens", "score"), "engine-rows")
        kept = selection.greedy_fill(rows.where(fragments.pinned()), int(budget * pinned_share))
        used = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        rest = selection.greedy_fill(rows.where(~fragments.pinned()), budget - used)
        return kept.withColumn("pinned", F.lit(True)).unionByName(rest.withColumn("pinned", F.lit(False)))

    def recall(self, doc_id: int, k: int = 10) -> DataFrame:
        """The fragments most like one, by fingerprint."""
        prints = dedup.simhash(self.docs.select("doc_id", "text"))
        asked = prints.where(F.col("doc_id") == doc_id).select(F.col("simhash").alias("h"))
        near = prints.where(F.col("doc_id") != doc_id).crossJoin(F.broadcast(asked))  # one row
        return near.select("doc_id", (1 - dedup.hamming(F.col("simhash"), F.col("h")) / 64).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(k)

    def search(self, terms: list[str]) -> DataFrame:
        return retrieval.bm25(self.docs, terms)

    def stats(self) -> DataFrame:
        text = self.docs.agg(F.count("*").alias("fragments"), F.sum(token_count(F.col("text"))).alias("tokens"), F.countDistinct("path").alias("paths"))
        return text.crossJoin(F.broadcast(self.events.agg(F.count("*").alias("events"))))  # one row each

    def security_report(self) -> DataFrame:
        return sast.report(sast.scan(self.docs, text="text"))

    def check(self, pairs: DataFrame, context: str, output: str) -> DataFrame:
        """pairs with a row for each claim of the output, held against the context."""
        found = pairs.withColumn("_c", F.explode(claims.certificates(context, output)))
        return found.select(*pairs.columns, "_c.*")

    def export(self) -> DataFrame:
        """A fragment a row as JSON."""
        return self.docs.select("doc_id", F.to_json(F.struct("doc_id", "path", "text")).alias("state"))

    def save(self, folder: str) -> str:
        files.save_checkpoint(self.docs, f"{folder}/docs", 0)
        files.save_checkpoint(self.events, f"{folder}/events", 0)
        return folder

    @classmethod
    def load(cls, spark: SparkSession, folder: str, docs: str, events: str) -> Engine:
        return cls(files.load_latest(spark, f"{folder}/docs", docs), files.load_latest(spark, f"{folder}/events", events))
