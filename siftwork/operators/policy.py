"""The policy that weighs recency, frequency, semantics and entropy: gradients by one aggregate, steps shaped by their spectrum."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

# --- fixed values: features, first weights, memory of covariance, rate, floor; memory of traces; share of information; bounds; pull to the prior ---
FEATURES = ("recency", "frequency", "semantic", "entropy")
FIRST = (0.30, 0.25, 0.25, 0.20)
BETA, RATE, EPSILON, START = 0.95, 0.01, 1e-6, 1e-4
TRACE, SHARE, LEAST_ENTROPY = 0.7, (0.1, 3.0), 0.01
BOUNDS, PULL, PULL_N = (0.05, 0.8), 0.10, 50.0
HOT, COLD, COOLING, JUMP = 2.0, 0.1, 0.998, 3.0


def jacobi(c: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a small symmetric matrix, by rotations that bring its largest entry off the diagonal to 0."""
    a, q, n = np.array(c, float), np.eye(len(c)), len(c)
    for _ in range(sweeps * n * n):
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), n)
        if n < 2 or off[i, j] <= 1e-14 * max(1e-300, np.abs(a).max()):
            break
        angle = 0.5 * math.atan2(2 * a[i, j], a[j, j] - a[i, i])
        r = np.eye(n)
        r[i, i] = r[j, j] = math.cos(angle)
        r[i, j], r[j, i] = math.sin(angle), -math.sin(angle)
        a, q = r.T @ a @ r, q @ r
    return np.diag(a).copy(), q


@dataclass(frozen=True)
class Policy:
    """Weights and what they were learnt with: a few numbers, whatever the number of fragments."""

    weights: tuple[float, ...] = FIRST
    prior: tuple[float, ...] = FIRST
    covariance: np.ndarray = field(default_factory=lambda: START * np.eye(len(FIRST)))
    temperature: float = HOT
    norm: float = 0.0
    seen: int = 0

    @property
    def condition(self) -> float:
        """The root of the greatest eigenvalue over the least: 1 where all directions are as sure as each other."""
        values, _ = jacobi(self.covariance)
        return math.sqrt(max(values.max(), 1e-10) / max(values.min(), 1e-10))

    @property
    def energy(self) -> tuple[float, ...]:
        """The share of each direction in the eigenvalues."""
        values = np.abs(jacobi(self.covariance)[0])
        return tuple(values / values.sum()) if values.sum() >= 1e-15 else (1 / len(values),) * len(values)


def whitened(policy: Policy, gradient: np.ndarray, rate: float = RATE) -> tuple[Policy, np.ndarray]:
    """(policy with the gradient in its covariance, step): directions whose gradients vary much get small steps."""
    covariance = BETA * policy.covariance + (1 - BETA) * np.outer(gradient, gradient)
    values, q = jacobi(covariance)
    return replace(policy, covariance=covariance), rate * (q @ ((q.T @ gradient) / np.sqrt(np.abs(values) + EPSILON)))


def credited(fragments: DataFrame, policy: Policy, price: float, chosen: str = "chosen", trace: str = "trace", tokens: str = "tokens") -> DataFrame:
    """fragments with advantage (for a reward of 1) and their trace renewed.

    The chance of selection is a logistic function of score less price * tokens; what was chosen is credited by its
    share of the entropy of all that was, and earlier choices by traces that fade. One row of sums is broadcast.
    """
    tau = max(policy.temperature, 0.01)
    worth = F.greatest("entropy", F.lit(LEAST_ENTROPY))
    total = fragments.agg(F.greatest(F.coalesce(F.sum(F.when(F.col(chosen), worth)), F.lit(0.0)), F.lit(LEAST_ENTROPY)).alias("_all"))
    score = sum((F.lit(w) * F.col(n) for n, w in zip(FEATURES, policy.weights, strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-(score - price * F.col(tokens)) / tau))
    rows = fragments.crossJoin(F.broadcast(total)).withColumn("_p", p)
    rows = rows.withColumn(trace, TRACE * F.coalesce(trace, F.lit(0.0)) + (F.col(chosen).cast("double") - F.col("_p")) * F.col("_p") * (1 - F.col("_p")) / tau)
    share = F.when(F.col(chosen), F.greatest(F.lit(SHARE[0]), F.least(F.lit(SHARE[1]), worth / F.col("_all")))).otherwise(1.0)
    return rows.withColumn("advantage", share * F.col(trace)).drop("_all", "_p")


def gradient(credits: DataFrame, reward: float) -> tuple[np.ndarray, int]:
    """(sums of advantage times each feature, fragments): one aggregate, five numbers to the driver."""
    found = credits.agg(F.count("*").alias("n"), *[F.sum(F.col("advantage") * F.lit(float(reward)) * F.col(n)).alias(n) for n in FEATURES]).first()
    return np.array([found[n] or 0.0 for n in FEATURES]), found["n"]


def cooled(policy: Policy, norm: float, n: int, gap: float | None) -> float:
    """The next temperature: hot again where gradients jump, else towards what gap and condition ask for, or slowly down."""
    if policy.norm > 1e-8 and norm > JUMP * policy.norm:
        return HOT
    if gap is not None and gap > 0 and n > 1:
        wanted = gap / (n * math.log(2)) * min(4.0, max(0.5, policy.condition / 2))
        return max(COLD, 0.9 * policy.temperature + 0.1 * min(HOT, max(COLD, wanted)))
    return max(COLD, policy.temperature * COOLING)


def update(policy: Policy, credits: DataFrame, reward: float, gap: float | None = None, rate: float = RATE) -> Policy:
    """The policy after an outcome: its weights move by the shaped step, stay in their bounds, and add up to 1.

    A pull to the prior fades with what was seen. Without fragments nothing changes. No row reaches the driver.
    """
    g, n = gradient(credits, reward)
    if not n:
        return policy
    norm = float(np.sqrt((g * g).sum()))
    temperature = cooled(policy, norm, n, gap)
    g = g - PULL / (1 + policy.seen / PULL_N) * (np.array(policy.weights) - np.array(policy.prior))
    after, step = whitened(policy, g, rate)
    weights = np.clip(np.array(policy.weights) + step, *BOUNDS)
    return replace(after, weights=tuple(float(w) for w in weights / weights.sum()), temperature=temperature, norm=0.95 * policy.norm + 0.05 * norm, seen=policy.seen + 1)


@pandas_udf(ArrayType(DoubleType()))
def eigenvalues(matrices: pd.Series) -> pd.Series:
    """Eigenvalues of small symmetric matrices (arrays by rows), greatest first; null where an entry is missing or no number."""
    out = []
    for m in matrices:
        flat = np.array([np.nan]) if m is None else np.asarray(m, float)
        n = math.isqrt(flat.size)
        out.append(sorted(jacobi(flat.reshape(n, n))[0].tolist(), reverse=True) if n * n == flat.size and np.isfinite(flat).all() else None)
    return pd.Series(out)


def covariances(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows (group, matrix): the covariance matrix of columns in each group, by rows, from partial sums."""
    cells = [F.covar_pop(a, b) for a in columns for b in columns]
    return df.groupBy(*group).agg(F.array(*cells).alias("matrix"))


# --- fixed values: first order of entropy, rate, outcomes for a step, memory, first push, bounds ---
ALPHA, ALPHA_RATE, EVERY, MEMORY, PUSH, ALPHA_BOUNDS = 2.0, 0.05, 50, 0.95, 0.1, (0.5, 8.0)


def adaptive_alpha(rows: DataFrame, key: str, order: str, hit: str) -> DataFrame:
    """Rows (key, alpha, hits, n): the order of entropy by which each cache judges what it keeps, learnt from its hits and misses.

    hits is a mean that fades; after every fifty outcomes alpha moves up the slope of hits that its last move
    showed, or is pushed where it has not moved, within its bounds. Outcomes count in order, null ones as misses.
    Each task streams its keys' outcomes and keeps four numbers of the one at hand; no key's outcomes are held.
    """
    kind = dict(rows.dtypes)[key]
    sorted_ = rows.select(key, order, F.coalesce(F.col(hit).cast("boolean"), F.lit(False)).alias("_hit")).repartition(key).sortWithinPartitions(key, order)

    def run(frames):
        now, state = None, None
        for pdf in frames:
            out = []
            for k, h in zip(pdf[key].tolist(), pdf["_hit"].tolist(), strict=True):
                k = None if k != k else k
                if state is None or k != now:
                    if state is not None:
                        out.append((now, state[0], state[1], state[4]))
                    now, state = k, [ALPHA, 0.0, ALPHA, 0.0, 0]
                state[1] = MEMORY * state[1] + (1 - MEMORY) * h
                state[4] += 1
                if state[4] % EVERY == 0:
                    alpha, hits, was, had, _ = state
                    step = ALPHA_RATE * (hits - had) / (alpha - was) if abs(alpha - was) > 1e-6 else PUSH
                    state[:4] = [min(ALPHA_BOUNDS[1], max(ALPHA_BOUNDS[0], alpha + step)), hits, alpha, hits]
            yield pd.DataFrame(out, columns=[key, "alpha", "hits", "n"])
        if state is not None:
            yield pd.DataFrame([(now, state[0], state[1], state[4])], columns=[key, "alpha", "hits", "n"])

    return sorted_.mapInPandas(run, f"{key} {kind}, alpha double, hits double, n long")
