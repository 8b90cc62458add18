"""Checking of claims in an answer against the evidence given before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms

# --- fixed values: thresholds and risks of verdicts ---
SUPPORT, CONTRADICTION, ADEQUACY = 0.62, 0.70, 0.72
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def claims(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Rows (conv, turn, place, claim): the sentences of 20 characters or more that are no questions."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+|\n+", "$1\x01"), "\x01")
    rows = df.select(conv, turn, F.posexplode(parts).alias("place", "claim")).withColumn("claim", F.trim("claim"))
    return rows.where((F.length("claim") >= 20) & ~F.col("claim").endswith("?"))


def weighted_adequacy(numbers: Column, words: Column, has_numbers: Column) -> Column:
    """The share of a claim's numbers and words that the evidence has; words alone if there are no numbers."""
    return F.when(has_numbers, 0.45 * numbers + 0.55 * words).otherwise(words)


def certify(support: Column, contradiction: Column, adequacy: Column) -> tuple[Column, Column]:
    """A verdict and its risk."""
    verdict = F.when(contradiction >= CONTRADICTION, "contradicted").when(support >= SUPPORT, "grounded").when(adequacy >= ADEQUACY, "unsupported").otherwise("unknown")
    risk = F.when(contradiction >= CONTRADICTION, 0.92).when(support >= SUPPORT, F.greatest(0.35 * (1 - support), F.lit(0.05))).when(adequacy >= ADEQUACY, 0.80).otherwise(0.55)
    return verdict, risk


def check_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Rows (conv, turn, place, support, verdict, risk) for each claim of an assistant, against all earlier user turns.

    Words of the evidence are kept by their first turn in the conversation, so that a claim's word is
    supported if it was there before: one equi-join of exploded words, no pairs of claims and evidence.
    """
    said = claims(df.where("role = 'assistant'"), conv, turn, text)
    items = said.select(conv, turn, "place", F.explode(F.concat(F.transform(F.array_distinct(query_terms(F.col("claim"))), lambda w: F.struct(F.lit(False).alias("number"), w.alias("item"))), F.transform(F.array_distinct(F.regexp_extract_all("claim", F.lit(NUMBER), F.lit(0))), lambda w: F.struct(F.lit(True).alias("number"), w.alias("item"))))).alias("x"))
    items = items.select(conv, turn, "place", "x.number", "x.item")
    given = df.where("role = 'user'")
    words = given.select(conv, turn, F.explode(F.concat(F.transform(query_terms(F.col(text)), lambda w: F.struct(F.lit(False).alias("number"), w.alias("item"))), F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda w: F.struct(F.lit(True).alias("number"), w.alias("item"))))).alias("x"))
    first = words.groupBy(conv, "x.number", "x.item").agg(F.min(turn).alias("first"))
    met = items.join(first, [conv, "number", "item"], "left").withColumn("met", F.coalesce(F.col("first") < F.col(turn), F.lit(False)).cast("int"))
    share = met.groupBy(conv, turn, "place").agg(
        F.coalesce(F.avg(F.when(~F.col("number"), F.col("met"))), F.lit(0.0)).alias("words"), F.avg(F.when(F.col("number"), F.col("met"))).alias("numbers")
    )
    support = weighted_adequacy(F.coalesce("numbers", F.lit(0.0)), F.col("words"), F.col("numbers").isNotNull())
    share = share.withColumn("support", support).withColumn("contradiction", F.when((F.col("numbers") < 1) & (F.col("words") >= ADEQUACY), F.lit(0.70)).otherwise(0.0))
    verdict, risk = certify(F.col("support"), F.col("contradiction"), F.col("words"))
    return share.select(conv, turn, "place", "support", verdict.alias("verdict"), risk.alias("risk"))


def answer_scores(checked: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows (conv, turn, score): one less the mean risk of the claims."""
    return checked.groupBy(conv, turn).agg((1 - F.avg("risk")).alias("score"), F.count("*").alias("claims"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
