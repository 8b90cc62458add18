"""Queries on selection for the benchmark's questions, and without a question for every conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import question
from .registry import query, table

BUDGET, OPEN_BUDGET = 1000, 300


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", X.token_count(F.col("text")).alias("tokens"))


@query("ret10_question_excerpts")
def ret10(spark, sf):
    """For each item of the benchmark the sentences of twelve documents that answer it; held against a plain version in the tests."""
    d, q = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return question.compressed(d, q, BUDGET).select("item_id", "place", "doc_id", "tokens", F.md5("excerpt").alias("excerpt"))


@query("ret10_budget_shares")
def ret10_shares(spark, sf):
    """The best documents of each item and what of the budget they may use; held against a plain version in the tests."""
    d, q = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return question.shares(question.file_scores(d, q, "doc_id", "text", "item_id", "text"), BUDGET, "item_id", "doc_id").select("item_id", "place", "doc_id", F.round("score", 6).alias("score"), "share")


@query("ret11_whole_files")
def ret11(spark, sf):
    """For each item whole conversations in order of BM25, turn by turn as they fit; held against a plain version in the tests."""
    return question.whole_files(_turns(spark, sf), table(spark, sf, "benchmark"), BUDGET, "conv_id", "turn", "text", "tokens")


@query("ret12_log_det")
def ret12(spark, sf):
    """A diverse choice of each conversation's turns by log-determinants; held against a dense greedy in the tests."""
    return question.without_question(_turns(spark, sf), OPEN_BUDGET, "conv_id", "turn", "text", "tokens")


_MARK = "('0x' || substr(md5(w), 1, 8))::BIGINT"


@query("ret13_hash_projection", rf"""
WITH w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS w FROM conversations),
s AS (SELECT conv_id, turn, {_MARK} % 64 AS place, sum(CASE WHEN {_MARK} >> 31 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM w GROUP BY ALL),
n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS norm FROM s GROUP BY ALL)
SELECT conv_id, turn, place::INT AS place, round(x / norm, 6)::DOUBLE AS x FROM s JOIN n USING (conv_id, turn) WHERE x <> 0""")
def ret13(spark, sf):
    """Each turn's words hashed with signs to 64 dimensions, of unit length; places that are not 0."""
    v = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(question.concepts(X.words_of(F.col("text")))).alias("place", "x"))
    return v.where("x <> 0").select("conv_id", "turn", "place", F.round("x", 6).alias("x"))
