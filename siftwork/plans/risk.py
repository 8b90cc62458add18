"""Queries on the risk of claims: sentences of turns, half of them set under the turn of another conversation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import risk
from ..sources.shared import written
from .registry import query, table

_KEY = ["conv_id", "turn"]


def claims(spark, sf):
    """(conv_id, turn, profile, claim, context, question, y): a turn's first sentence is held against that turn, or against the same turn of the next conversation, where it is made up."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").withColumn("question", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    other = c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("foreign"))
    sentence = lambda t: F.element_at(F.split(t, r"(?<=[.!?])\s+"), 1)
    made_up = (F.col("conv_id") + F.col("turn")) % 2 == 1
    rows = c.join(other, _KEY, "left").where(~made_up | F.col("foreign").isNotNull())
    return rows.select(*_KEY, F.col("role").alias("profile"), sentence(F.when(made_up, F.col("foreign")).otherwise(F.col("text"))).alias("claim"), F.col("text").alias("context"), "question", made_up.cast("int").alias("y"))


def featured(spark, sf):
    rows = claims(spark, sf)
    return written(risk.features(rows, idf=risk.corpus_idf(table(spark, sf, "conversations"), "text")), "risk-features")


def _r(names):
    return [F.round(n, 6).alias(n) for n in names]


@query("wit14_claim_features")
def wit14(spark, sf):
    """The nine features of every claim; held against a plain version in the tests."""
    return featured(spark, sf).select(*_KEY, *_r(risk.FEATURES))


@query("wit18_fitted_risk")
def wit18(spark, sf):
    """The risk of every claim by weights that were fitted to three conversations of four; held against numpy in the tests."""
    f = featured(spark, sf)
    weights, bias = risk.fit(f.where("conv_id % 4 <> 3"))
    return f.select(*_KEY, "y", (F.col("conv_id") % 4 == 3).alias("held_out"), F.round(risk.predicted(weights, bias), 6).alias("risk"))


@query("wit19_thresholds")
def wit19(spark, sf):
    """Thresholds of every profile, from conversations that the weights were not fitted to; held against a plain version in the tests."""
    f = wit18(spark, sf).join(claims(spark, sf).select(*_KEY, "profile"), _KEY)
    return risk.calibrate(f.where("held_out"), "profile", "risk", "y")


@query("wit19_actions")
def wit19_actions(spark, sf):
    """What is done with every claim by its profile's usual thresholds; held against a plain version in the tests."""
    profile = F.when(F.col("profile") == "assistant", "qa").when(F.col("profile") == "user", "chat").otherwise("Summarization")
    f = featured(spark, sf).withColumn("risk", risk.predicted()).withColumn("t", risk.default_thresholds(profile))
    return f.select(*_KEY, risk.action(F.col("risk"), F.col("t.tau_pass"), F.col("t.tau_hedge"), F.col("t.tau_warn")).alias("action"))


@query("wit21_training_record")
def wit21(spark, sf):
    """How a step on labelled claims moves the mean risk of each profile and label; held against numpy in the tests."""
    label = F.when(F.col("turn") % 5 == 4, "no such label").when(F.col("y") == 1, F.when(F.col("turn") % 2 == 0, "ci_failed").otherwise(" Rejected ")).otherwise(F.when(F.col("turn") % 2 == 0, "grounded").otherwise("accepted"))
    audit, _, _ = risk.record(featured(spark, sf).withColumn("label", label), "profile", "label")
    return audit.select("profile", "label", "y", "n", *_r(["before", "after"]))
