"""Selection under a budget of tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def greedy_fill(df: DataFrame, budget: int, key: str = "doc_id", tokens: str = "tokens", score: str = "score", chunk: int = 10_000) -> DataFrame:
    """Rows (key, tokens, score, place): first fit by descending score per token, then key.

    The rows are met in order, a chunk at a time: each chunk is a distributed top-k among the rows behind the
    last one that still fit, of which only key, tokens and score reach the driver. It ends when nothing fits,
    so at most budget / least tokens rows are kept; no row that fits is passed over. What is ordered is written
    once and paged through, so df is computed once; densities count to twelve places, that equal ones tie.
    """
    spark = df.sparkSession
    rows = written(df.select(key, tokens, score).where(F.col(tokens) > 0).withColumn("density", F.round(F.col(score) / F.col(tokens), 12)), "selection-rows")
    left, taken, last = budget, [], None
    while left > 0:
        rest = rows.where(F.col(tokens) <= left)
        if last:
            rest = rest.where((F.col("density") < last[0]) | ((F.col("density") == last[0]) & (F.col(key) > last[1])))
        part = rest.orderBy(F.desc("density"), F.asc(key)).limit(chunk).collect()
        for r in part:
            if r[tokens] <= left:
                left -= r[tokens]
                taken.append((r[key], r[tokens], r[score], len(taken)))
        if len(part) < chunk:
            break
        last = (part[-1]["density"], part[-1][key])
    kinds = dict(df.dtypes)
    return spark.createDataFrame(taken, f"{key} {kinds[key]}, {tokens} {kinds[tokens]}, {score} {kinds[score]}, place int")


def ranked_fill(df: DataFrame, group: str, budget: int, order: list, tokens: str = "tokens") -> DataFrame:
    """Rows of each group in order while the running sum of tokens is within the budget."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def first_fit(df: DataFrame, group: str, budget: int, order: list, keep: list[str], candidates: int = 50, tokens: str = "tokens") -> DataFrame:
    """Rows (group, place, used, *keep) of each group's best candidates, in order, that fit what is left of the budget.

    Only the first so many rows of a group are looked at, which is what bounds the array that a group is folded
    over; a row that does not fit is passed over, and smaller ones behind it may still be taken. place counts
    from 1; used is the sum of tokens so far. Rows of null or no tokens are left out.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(tokens) > 0).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= candidates)
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(tokens).cast("long").alias("_t"), *keep))).alias("rows"))
    fits = lambda acc, x: acc["used"] + x["_t"] <= budget
    # the fold keeps the sum, and the sum at each row that was taken (null at others)
    step = lambda acc, x: F.struct((acc["used"] + F.when(fits(acc, x), x["_t"]).otherwise(0)).alias("used"), F.concat(acc["at"], F.array(F.when(fits(acc, x), acc["used"] + x["_t"]))).alias("at"))
    sums = F.aggregate("rows", F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("at")), step, lambda acc: acc["at"])
    taken = F.filter(F.zip_with("rows", sums, lambda row, used: F.struct(row.alias("row"), used.alias("used"))), lambda x: x["used"].isNotNull())
    out = listed.select(group, F.posexplode(taken).alias("place", "x"))
    return out.select(group, (F.col("place") + 1).alias("place"), F.col("x.used").alias("used"), *[F.col(f"x.row.{c}").alias(c) for c in keep])


def knapsack(values: np.ndarray, costs: np.ndarray, budget: int) -> list[int]:
    """0/1 dynamic programme over costs in steps of budget / 1000, values to four places."""
    step = max(budget // 1000, 1)
    room, worth = budget // step, np.round(values * 10_000).astype(np.int64)
    cost = (costs // step).astype(np.int64)
    best = np.zeros(room + 1, np.int64)
    took = np.zeros((len(costs), room + 1), bool)
    for k in range(len(costs)):
        if cost[k] <= room:
            other = np.full(room + 1, -1, np.int64)
            other[cost[k] :] = best[: room + 1 - cost[k]] + worth[k]
            took[k] = other > best
            best = np.maximum(best, other)
    chosen, at = [], room
    for k in range(len(costs) - 1, -1, -1):
        if took[k, at]:
            chosen.append(k)
            at -= cost[k]
    return chosen[::-1]


def knapsack_groups(df: DataFrame, group: str, key: str, value: str, cost: str, budget: int) -> DataFrame:
    """Rows (group, key) chosen by dynamic programming in each group, never over the budget."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        chosen = knapsack(pdf[value].to_numpy(float), pdf[cost].to_numpy(np.int64), budget)
        # costs are rounded down to steps: what goes over the budget is given back, the least worth first
        while pdf[cost].iloc[chosen].sum() > budget:
            chosen.remove(min(chosen, key=lambda k: pdf[value].iloc[k]))
        return pdf.iloc[chosen][[group, key]]

    return df.select(group, key, value, cost).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}")


def lambda_star(df: DataFrame, budget: float, score: str = "score", tokens: str = "tokens", tau: float = 0.5, rounds: int = 6, width: int = 32) -> float:
    """The price of a token at which the expected use, sum of sigmoid((score - price * tokens) / tau) * tokens, meets the budget.

    Each round evaluates a grid of prices in one pass over scores and tokens, which are written once, and goes on
    between the two around the budget.
    """
    df = written(df.select(score, tokens), "selection-scores")
    low, high = 0.0, 1.0
    use = lambda p: F.sum(F.col(tokens) / (1 + F.exp(-(F.col(score) - p * F.col(tokens)) / tau)))
    if df.agg(use(0.0)).first()[0] <= budget:
        return 0.0
    while df.agg(use(high)).first()[0] > budget:
        high *= 4
    for _ in range(rounds):
        grid = np.linspace(low, high, width + 1)
        found = df.agg(*[use(float(p)).alias(f"p{k}") for k, p in enumerate(grid)]).first()
        k = max(i for i in range(width + 1) if found[i] > budget or i == 0)
        low, high = float(grid[k]), float(grid[min(k + 1, width)])
    return high


def soft_select(df: DataFrame, budget: int, key: str = "doc_id", score: str = "score", tokens: str = "tokens", tau: float = 0.5) -> DataFrame:
    """Rows by their chance of selection at the price that meets the budget, first fit; the budget always holds."""
    df = written(df.select(key, score, tokens), "selection-fragments")
    price = lambda_star(df, budget, score, tokens, tau)
    chance = 1 / (1 + F.exp(-(F.col(score) - price * F.col(tokens)) / tau))
    return greedy_fill(df.select(key, tokens, (chance * F.col(tokens)).alias("chance")), budget, key, tokens, "chance")


def marginal_gain(df: DataFrame, module: str, relevance: str, key: str) -> DataFrame:
    """df with gain: relevance over the place within its module, by descending relevance."""
    from pyspark.sql import Window

    w = Window.partitionBy(module).orderBy(F.desc(relevance), F.asc(key))
    return df.withColumn("gain", F.col(relevance) / F.row_number().over(w))


def pairwise_diversity(prints: DataFrame, column: str = "simhash") -> DataFrame:
    """One row: the mean pairwise Hamming distance over 64, from the counts of each bit and no pairs."""
    ones = [F.sum(F.shiftrightunsigned(column, b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]
    counts = prints.agg(F.count("*").alias("n"), *ones)
    total = sum((F.col(f"b{b}") * (F.col("n") - F.col(f"b{b}")) for b in range(64)), F.lit(0))
    return counts.select("n", F.when(F.col("n") <= 1, 1.0).otherwise(total / (64.0 * F.col("n") * (F.col("n") - 1) / 2)).alias("diversity"))


RESOLUTIONS = (("full", 1.0, 1.0), ("skeleton", 0.30, 0.70), ("belief", 0.08, 0.50), ("reference", 0.01, 0.15))


def multi_resolution(df: DataFrame, group: str, key: str, score: str, tokens: str, simhash: str, budget: int, floor: float = 0.1) -> DataFrame:
    """Rows (group, key, resolution, cost): greedy by information, relevance and diversity per token, one resolution a row.

    A coarser form is taken only where the full one does not fit. Each group is one question's candidates.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        t, s = pdf[tokens].to_numpy(np.int64), pdf[score].to_numpy(float)
        bits = pdf[simhash].to_numpy(np.int64).view(np.uint64)
        if t.sum() <= budget:
            return pd.DataFrame({group: pdf[group], key: pdf[key], "resolution": "full", "cost": t})
        left, open_, near, out = budget, np.ones(len(t), bool), np.zeros(len(t)), []
        costs = [np.maximum(1, (t * share).astype(np.int64)) for _, share, _ in RESOLUTIONS]
        while open_.any():
            worth = s * np.maximum(1 - near, floor)
            best = (-1.0, -1, -1)
            for r, (_, _, info) in enumerate(RESOLUTIONS):
                fits = open_ & (costs[r] <= left) & ((r == 0) | (costs[0] > left))
                if fits.any():
                    density = np.where(fits, info * worth / costs[r], -1.0)
                    k = int(density.argmax())
                    if density[k] > best[0]:
                        best = (density[k], k, r)
            if best[1] < 0:
                break
            _, k, r = best
            open_[k] = False
            left -= costs[r][k]
            near = np.maximum(near, 1 - np.bitwise_count(bits ^ bits[k]) / 64)
            out.append((k, RESOLUTIONS[r][0], costs[r][k]))
        picked = [k for k, _, _ in out]
        return pd.DataFrame({group: pdf[group].to_numpy()[picked], key: pdf[key].to_numpy()[picked], "resolution": [x for _, x, _ in out], "cost": [c for _, _, c in out]})

    return df.select(group, key, score, tokens, simhash).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, resolution string, cost long")


def mmr(df: DataFrame, group: str, key: str, score: str, tokens: str, terms: str, budget: int, weight: float = 0.7) -> DataFrame:
    """Rows (group, key, place): greedy by weight * score - (1 - weight) * greatest Jaccard to those taken."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        sets = [set(x) for x in pdf[terms]]
        near, left, taken, open_ = np.zeros(len(pdf)), budget, [], np.ones(len(pdf), bool)
        s, t = pdf[score].to_numpy(float), pdf[tokens].to_numpy(np.int64)
        while True:
            fits = open_ & (t <= left)
            if not fits.any():
                break
            k = int(np.where(fits, weight * s - (1 - weight) * near, -np.inf).argmax())
            taken.append(k)
            open_[k] = False
            left -= t[k]
            near = np.maximum(near, [len(x & sets[k]) / max(1, len(x | sets[k])) for x in sets])
        return pd.DataFrame({group: pdf[group].iloc[taken], key: pdf[key].iloc[taken], "place": range(len(taken))})

    return df.select(group, key, score, tokens, terms).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, place long")


