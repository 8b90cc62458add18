"""Fragments with the features that selection weighs, from documents and the log of how they were used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.information import normalized_entropy, shannon_entropy
from ..functions.text import criticality, token_count
from .learning import wilson_lower

# --- fixed values: weights of recency, frequency, semantics and entropy; places by criticality ---
WEIGHTS = {"recency": 0.30, "frequency": 0.25, "semantic": 0.25, "entropy": 0.20}
PLACES = (("safety", 50.0), ("critical", 30.0), ("important", 10.0))
PINNED = ("safety", "critical")


def usage(events: DataFrame, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """Rows (key, last, accesses, wins, losses): the last turn that touched a fragment, how often, and how it fared."""
    kind = F.col("event_type")
    return events.groupBy(key).agg(F.max(order).alias("last"), F.count("*").alias("accesses"), F.count_if(kind == "purchase").alias("wins"), F.count_if(kind == "error").alias("losses"))


def features(docs: DataFrame, events: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (key, path, text) with tokens, entropy, recency, frequency, semantic, feedback, wins and losses instead of the text.

    Recency halves every tenth of the log; frequency is relative to the most used fragment; semantic is the share of
    the terms that a text has; feedback is 0.5 to 2 by the lower end of Wilson's interval, 1 without any. Texts are
    read before the log is joined, so none is shuffled. One row of totals is broadcast.
    """
    used = usage(events)
    totals = used.agg(F.max("last").alias("now"), F.max("accesses").alias("most"))
    low = F.lower(F.col(text))
    semantic = reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms]) / len(terms)
    read = docs.select(key, "path", token_count(F.col(text)).alias("tokens"), normalized_entropy(shannon_entropy(text)).alias("entropy"), semantic.alias("semantic"))
    rows = read.join(used, read[key] == used["user_id"], "left").crossJoin(F.broadcast(totals))
    n = (F.col("wins") + F.col("losses")).cast("double")
    return rows.select(
        key, "path", "tokens", "entropy",
        F.coalesce(F.exp(-F.log(F.lit(2.0)) * (F.col("now") - F.col("last")) / (F.col("now") / 10 + 1)), F.lit(0.0)).alias("recency"),
        (F.coalesce("accesses", F.lit(0)) / F.col("most")).alias("frequency"),
        "semantic",
        F.when(n > 0, 0.5 + 1.5 * wilson_lower(F.col("wins") / n, n)).otherwise(1.0).alias("feedback"),
        F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"), F.coalesce("accesses", F.lit(0)).alias("accesses"),
    )


def linear_score() -> Column:
    """The weighted features times the feedback, without a cap."""
    return reduce(lambda a, b: a + b, [w * F.col(c) for c, w in WEIGHTS.items()]) * F.greatest("feedback", F.lit(0.01))


def context_score(similarity: Column) -> Column:
    """A recalled fragment's score by similarity, recency, entropy and frequency, at most 1."""
    return F.least(F.lit(1.0), F.col("feedback") * (0.45 * similarity + 0.25 * F.col("recency") + 0.20 * F.col("entropy") + 0.10 * F.col("frequency")))


def pinned() -> Column:
    return criticality(F.col("path")).isin(*PINNED)


def ordering_priority(score: Column, links: Column) -> Column:
    """Where a chosen fragment stands: pinned ones first, then by criticality, links and score."""
    kind, place = criticality(F.col("path")), F.lit(0.0)
    for name, worth in PLACES:
        place = F.when(kind == name, worth).otherwise(place)
    return score + F.when(pinned(), 100.0).otherwise(0.0) + place + F.least(links, F.lit(20))


def blocked(left: DataFrame, right: DataFrame, rows: int, n_left: int, n_right: int, key: str, other: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers (i, j), so that each pair of rows meets in one group of bounded size."""
    cuts_left, cuts_right = max(1, -(-n_left // rows)), max(1, -(-n_right // rows))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30))
    a = left.withColumn("i", (spot(key) % cuts_left).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cuts_right - 1))))
    b = right.withColumn("j", (spot(other or key) % cuts_right).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cuts_left - 1))))
    return a, b
