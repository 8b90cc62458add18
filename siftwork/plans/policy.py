"""Queries on the learnt policy: outcomes in the event log move the weights of documents' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy
from ..sources.shared import written
from .fragments import features
from .registry import query, table

EPOCHS, PRICE = 6, 0.0005
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SCALES = (50, 100_000, 0.1, 0.1)


def outcomes(spark, sf):
    """(epoch, reward, chosen): the event log in stretches of equal length; what was clicked or viewed was chosen, and purchases less errors are the reward."""
    e = table(spark, sf, "events")
    ends = e.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    e = e.crossJoin(F.broadcast(ends)).withColumn("epoch", F.floor((F.col("event_id") - F.col("lo")) * EPOCHS / (F.col("hi") - F.col("lo") + 1)).cast("int"))  # one row
    kind = F.col("event_type")
    rewards = e.groupBy("epoch").agg(((F.count_if(kind == "purchase") - F.count_if(kind == "error")) / F.count("*")).alias("reward"))
    return {r.epoch: r.reward for r in rewards.collect()}, written(e.where(kind.isin("click", "view")).select("epoch", F.col("user_id").alias("doc_id")).distinct(), "policy-chosen")


def learnt(spark, sf):
    """[(epoch, policy)]: the policy after each stretch of the log, over the features of all documents."""
    rewards, chosen = outcomes(spark, sf)
    rows = written(features(spark, sf).select("doc_id", "tokens", *policy.FEATURES, F.lit(0.0).alias("trace")), "policy-features")
    p, out = policy.Policy(), []
    for epoch in range(EPOCHS):
        now = chosen.where(F.col("epoch") == epoch).select("doc_id", F.lit(True).alias("_c"))
        marked = rows.join(now, "doc_id", "left").withColumn("chosen", F.coalesce("_c", F.lit(False))).drop("_c")
        credits = written(policy.credited(marked, p, PRICE), "policy-credits")
        p = policy.update(p, credits, rewards.get(epoch, 0.0))
        rows = credits.drop("chosen", "advantage")
        out.append((epoch, p))
    return out


@query("lrn8_policy_update")
def lrn8(spark, sf):
    """Weights and temperature after each stretch of the log; held against numpy in the tests."""
    rows = [(e, *map(float, p.weights), p.temperature) for e, p in learnt(spark, sf)]
    return spark.createDataFrame(rows, "epoch int, recency double, frequency double, semantic double, entropy double, temperature double")


@query("lrn9_spectral_state")
def lrn9(spark, sf):
    """The spectrum of the gradients so far after each stretch: the condition, and each direction's share; held against numpy in the tests."""
    rows = [(e, p.condition, k, float(x)) for e, p in learnt(spark, sf) for k, x in enumerate(sorted(p.energy, reverse=True))]
    return spark.createDataFrame(rows, "epoch int, condition double, direction int, energy double")


_CELL = "(avg(x{i} * x{j}) - avg(x{i}) * avg(x{j}))"
_CELLS = [_CELL.format(i=i, j=j) for i in range(4) for j in range(4)]


@query("lrn10_eigenvalues", f"""
WITH s AS (SELECT l_suppkey, {', '.join(f'{c} / {s} AS x{k}' for k, (c, s) in enumerate(zip(COLUMNS, _SCALES, strict=True)))} FROM lineitem),
m AS (SELECT l_suppkey, {' + '.join(_CELL.format(i=i, j=i) for i in range(4))} AS trace, {' + '.join(f'{c} * {c}' for c in _CELLS)} AS squares FROM s GROUP BY l_suppkey)
SELECT l_suppkey, round(trace, 6)::DOUBLE AS trace, round(squares, 6)::DOUBLE AS squares FROM m""")
def lrn10(spark, sf):
    """Eigenvalues of every supplier's covariances, as their sum and the sum of their squares, which SQL has of the matrix."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", *[(F.col(c) / s).alias(c) for c, s in zip(COLUMNS, _SCALES, strict=True)])
    v = policy.covariances(rows, ["l_suppkey"], COLUMNS).withColumn("v", policy.eigenvalues("matrix"))
    total = lambda f: F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x)), 6)
    return v.select("l_suppkey", total(lambda x: x).alias("trace"), total(lambda x: x * x).alias("squares"))


@query("lrn34_adaptive_alpha")
def lrn34(spark, sf):
    """The order of entropy that each cache of ten customers' orders has learnt: urgent orders are hits; held against a plain fold in the tests."""
    o = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 10).alias("cache"), "o_orderkey", F.substring("o_orderpriority", 1, 1).isin("1", "2").alias("hit"))
    out = policy.adaptive_alpha(o, "cache", "o_orderkey", "hit")
    return out.select("cache", F.round("alpha", 6).alias("alpha"), F.round("hits", 6).alias("hits"), "n")
