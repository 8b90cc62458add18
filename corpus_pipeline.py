"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, and SentencePiece encoding, one written table after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import line_dedup, mixing, near_copies, pieces, quality_rules
from siftwork.llm.common import drop, written


def _beside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage makes of docs, in the columns of docs: those named as the stage's own columns are put aside meanwhile."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in names}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep.

    Null and empty texts have too few words and go; repeated rows are judged alike; ties at the threshold stay.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    return _beside(docs, own, lambda d: quality_rules.scored(d, quality_rules.trusted_ids(spark, sf_dir)).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; n_chars, where docs have it, follows the text.

    No row goes: a text may become empty, a null text stays null. Rows repeated with one doc_id and text fare
    alike, and rows without a doc_id come after all others.
    """
    out = _beside(docs, ("n_lines", "n_removed", "_doc", "_version", "_gone", "_lines"), line_dedup.dedup_lines)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one of the smallest doc_id.

    Null texts and texts without words are one group; rows without a doc_id come last in theirs; of repeated
    rows one stays.
    """
    return near_copies.keep_one(docs, width=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, shuffled.

    Null sources are a source of their own; rows without a doc_id are drawn by their text; null texts have no
    size and are copied at the rate of their source.
    """
    return _beside(docs, ("copy", "shuffle_key", "copies", "of", "parts", "cdf", "pepper", "salt"), mixing.mix)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, with doc_id and, where docs have them, lang and source. Null and empty texts have no ids."""
    return pieces.encode(docs).select(*[c for c in ("doc_id", "lang", "source") if c in docs.columns], "ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near), ("mixing", mixed), ("sentencepiece", encoded)]

#: SQL has no form of the log-likelihood ratio's hashes, of linked groups of near copies or of the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
