"""Feedback, bandits, running averages and budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def wilson_lower(p: Column, n: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval for a rate p of n."""
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def reward_variance(value: Column) -> Column:
    """The sample variance from 0.001 to 1; 1 for a single value."""
    return F.when(F.count("*") < 2, 1.0).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(1.0), F.var_samp(value))))


def modulated_reward(success: Column, sufficiency: Column) -> Column:
    s = F.when(sufficiency.isNull() | F.isnan(sufficiency), 0.5).otherwise(sufficiency)
    return F.when(success, 0.5 + 0.5 * s).otherwise(-(1.5 - s))


def admission(a: Column, b: Column, entropy: Column, utility: Column) -> Column:
    """How much a cache wants an entry: optimistic mean of Beta(a, b), and its use."""
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return 0.6 * F.least(F.lit(1.0), a / (a + b) + spread * entropy) + 0.4 * utility


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def poisson_surprise(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / expected) - seen + expected).otherwise(expected)


def _in_order(df: DataFrame, key: str, order: str, value) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v")))).alias("rows"))


def ema_by_key(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """Rows (key, ema): the running average after a key's last row, from its first."""
    rows = _in_order(df, key, order, value)
    fold = F.aggregate("rows", F.lit(None).cast("double"), lambda a, x: F.coalesce((1 - alpha) * a + alpha * x["v"], x["v"]))
    return rows.select(key, fold.alias("ema"))


def cusum(df: DataFrame, key: str, order: str, value: Column, alpha: float = 0.15, slack: float = 0.05) -> DataFrame:
    """Rows (key, n, ema, up, down, state): EMA and one-sided sums after a key's last row."""
    rows = _in_order(df, key, order, value)
    zero = F.struct(F.lit(0.0).alias("ema"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    step = lambda a, x: F.struct(
        ((1 - alpha) * a["ema"] + alpha * x["v"]).alias("ema"), F.greatest(F.lit(0.0), a["up"] + x["v"] - slack).alias("up"), F.greatest(F.lit(0.0), a["down"] - x["v"] - slack).alias("down")
    )
    out = rows.select(key, F.size("rows").alias("n"), F.aggregate("rows", zero, step).alias("s")).select(key, "n", *[F.round(f"s.{c}", 6).alias(c) for c in ("ema", "up", "down")])
    state = F.when((F.col("n") >= 5) & ((F.col("ema") < -0.20) | (F.col("down") > 3)), "declining").when(F.col("ema") > 0.15, "improving").otherwise("stable")
    return out.withColumn("state", state)


def online_weights(events: DataFrame, order: str, kinds: list[str], rate: float = 0.5, block: int = 1000) -> DataFrame:
    """Rows (kind, weight): Dirichlet counts moved by each block's reward over its running average.

    Rewards are first summed by block of the order, so that what is folded in sequence is small.
    """
    sums = events.groupBy(F.floor(F.col(order) / block).alias("block")).agg(F.avg("value").alias("r"), *[F.avg((F.col("event_type") == k).cast("int")).alias(k) for k in kinds])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        alpha, ema = dict.fromkeys(kinds, 1.0), None
        for n, r in enumerate(pdf.itertuples()):
            ema = r.r if ema is None else 0.9 * ema + 0.1 * r.r
            for k in kinds:
                alpha[k] = max(0.1, alpha[k] + rate / (n + 1) ** 0.5 * (r.r - ema) / 100 * getattr(r, k))
        total = sum(alpha.values())
        return pd.DataFrame({"kind": kinds, "weight": [round(alpha[k] / total, 6) for k in kinds]})

    return sums.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "kind string, weight double")


def mmd_squared(cloud: DataFrame, key: str, vector: str, label: str, width: float, rows: int = 2_000) -> DataFrame:
    """One row: the squared maximum mean discrepancy of labels 0 and 1 under a Gaussian kernel, with the diagonal.

    Kernel means are sums over blocks of vectors: each pair of blocks is one group of bounded size.
    """
    from .fragments import blocked

    some = cloud.where(F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    n = some.count()

    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in (0, 1):
            for q in (0, 1):
                x, y = left["v"][left["label"] == p], right["v"][right["label"] == q]
                if len(x) and len(y):
                    x, y = np.stack(x.to_numpy()), np.stack(y.to_numpy())
                    total = sum(float(np.exp(-((y - u) ** 2).sum(axis=1) / (2 * width * width)).sum()) for u in x)
                    out.append((p, q, total, len(x) * len(y)))
        return pd.DataFrame(out, columns=["p", "q", "total", "n"])

    a, b = blocked(some, some, rows, n, n, "id")
    sums = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, "p int, q int, total double, n long")
    mean = lambda p, q: F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("total"))) / F.sum(F.when((F.col("p") == p) & (F.col("q") == q), F.col("n")))
    return sums.agg((mean(0, 0) + mean(1, 1) - 2 * mean(0, 1)).alias("mmd"))


def conformal_quantile(df: DataFrame, group: str, value: str, alpha: float) -> DataFrame:
    """Rows (group, q): the value of rank ceil((n + 1)(1 - alpha)), at most n; from counts of equal values."""
    from pyspark.sql import Window

    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    placed = counts.withColumn("to", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    rank = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * (1 - alpha))))
    return placed.where(F.col("to") >= rank).groupBy(group).agg(F.min(value).alias("q"))


def allocate(agents: DataFrame, key: str, budget: int, floor: int = 1, rounds: int = 40) -> DataFrame:
    """Rows (key, share): the budget by demand and weight, each agent at least the floor and at most its demand.

    The price is found by bisection; each step is one aggregate over the agents.
    """
    n = agents.count()
    if n * floor >= budget:
        return agents.select(key, F.lit(floor).cast("double").alias("share"))
    wants = lambda p: F.least(F.col("demand").cast("double"), floor + F.col("weight") / p)
    low, high = 1e-12, 1e6
    for _ in range(rounds):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if agents.agg(F.sum(wants(mid))).first()[0] > budget else (low, mid)
    return agents.select(key, F.round(wants(high), 4).alias("share"))
