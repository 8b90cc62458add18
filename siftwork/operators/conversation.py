"""Pruning of conversations to a budget, and of old tool outputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.information import renyi_entropy_2, shannon_entropy
from ..functions.text import ngrams, token_count, words_of

# --- fixed values: protection by kind of block; share of tokens and of information kept by resolution ---
SHIELD = {"system": 1.00, "user": 0.95, "assistant": 0.60, "tool_call": 0.25, "tool_result": 0.15, "thinking": 0.10}
LEVELS = (("verbatim", 1.00, 1.00), ("skeleton", 0.30, 0.85), ("digest", 0.08, 0.35), ("fingerprint", 0.01, 0.05))


def kind_of(role: Column) -> Column:
    return F.when(role == "system", "system").when(role == "user", "user").when(role == "tool", "tool_result").otherwise("assistant")


def shield(kind: Column) -> Column:
    out = None
    for name, value in SHIELD.items():
        out = (F if out is None else out).when(kind == name, value)
    return out.otherwise(0.0)


def forward_overlap(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Rows (conv, turn, overlap): the share of a block's word pairs that a later block has; 0.5 for the last block.

    A pair is looked up by its last turn in the conversation: one grouping, no pairs of blocks.
    """
    rows = df.select(conv, turn, words_of(F.col(text)).alias("w"))
    grams = rows.select(conv, turn, F.explode(F.array_distinct(ngrams(F.col("w"), 2))).alias("g"))
    later = grams.groupBy(conv, "g").agg(F.max(turn).alias("to"))
    share = grams.join(later, [conv, "g"]).groupBy(conv, turn).agg(F.avg((F.col("to") > F.col(turn)).cast("int")).alias("share"))
    last = rows.groupBy(conv).agg(F.max(turn).alias("last"))
    out = rows.join(share, [conv, turn], "left").join(last, conv)
    return out.select(conv, turn, F.when(F.col(turn) == F.col("last"), 0.5).otherwise(F.coalesce("share", F.lit(0.0))).alias("overlap"))


def block_scores(df: DataFrame, decay: float = 0.1, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """df with tokens, kind and value of each block: overlap ahead, references to it, recency, protection, less noise."""
    w = Window.partitionBy(conv).orderBy(turn)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("kind", kind_of(F.col("role"))).withColumn("tokens", token_count(F.col("text")))
    rows = rows.withColumn("parent", F.last(F.when(F.col("kind") == "user", F.col(turn)), ignorenulls=True).over(before))
    refs = rows.where("parent is not null").groupBy(conv, F.col("parent").alias(turn)).agg(F.count("*").alias("refs"))
    ends = rows.groupBy(conv).agg(F.max(turn).alias("last"), F.count("*").alias("n"))
    div = F.greatest(shannon_entropy("text") - renyi_entropy_2("text"), F.lit(0.0))
    noise = F.when((F.octet_length("text") > 50) & (F.col("div") > 1.5), F.least(F.col("div") - 1.5, F.lit(1.0)) * 0.15).otherwise(0.0)
    rows = rows.withColumn("div", div).join(refs, [conv, turn], "left").join(ends, conv).join(forward_overlap(df, conv, turn), [conv, turn])
    density = F.least(F.coalesce("refs", F.lit(0)) / F.col("n"), F.lit(1.0))
    raw = 0.25 * F.col("overlap") + 0.20 * density + 0.25 * F.exp(-decay * (F.col("last") - F.col(turn))) + 0.25 * shield(F.col("kind")) - noise
    return rows.select(conv, turn, "kind", "tokens", "parent", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("value"))


def choose_levels(tokens: np.ndarray, value: np.ndarray, protected: np.ndarray, budget: int) -> np.ndarray:
    """The level of each block: the least price of information per token saved at which enough is freed."""
    none = np.zeros(len(tokens), int)
    wanted = tokens.sum() - budget
    if wanted <= 0:
        return none
    saved = np.stack([np.where(protected, 0.0, tokens * (1 - share)) for _, share, _ in LEVELS])
    if saved[-1].sum() < 1:
        return none
    if saved[-1].sum() < wanted:
        return np.where(protected, 0, len(LEVELS) - 1)
    cost = np.stack([value * (1 - kept) for _, _, kept in LEVELS])
    price = np.where(saved >= 1, cost / np.maximum(saved, 1e-12), np.inf)
    price[0] = 0.0
    # the levels only change at the blocks' own prices: the least of these that frees enough
    for p in np.unique(price[np.isfinite(price)]):
        level = np.where(price <= p, saved, -1.0).argmax(axis=0)
        if saved[level, np.arange(len(tokens))].sum() >= wanted:
            return level
    return np.where(protected, 0, len(LEVELS) - 1)


def prune(df: DataFrame, budget: int, protect_last: int = 2, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows (conv, turn, resolution, kept_tokens): each conversation brought to the budget.

    User and system blocks stay whole, the last ones lose a skeleton's worth at most, and a block is no fuller
    than the one it depends on, unless it is protected. One group is one conversation, of narrow rows.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(turn).reset_index(drop=True)
        protected = pdf["kind"].isin(["user", "system"]).to_numpy()
        level = choose_levels(pdf["tokens"].to_numpy(float), pdf["value"].to_numpy(float), protected, budget)
        at = {t: k for k, t in enumerate(pdf[turn])}
        for k, parent in enumerate(pdf["parent"]):
            if not pd.isna(parent) and not protected[k]:
                level[k] = max(level[k], level[at[int(parent)]])
        if protect_last:
            level[-protect_last:] = np.minimum(level[-protect_last:], 1)
        share = np.array([s for _, s, _ in LEVELS])[level]
        return pd.DataFrame({conv: pdf[conv], turn: pdf[turn], "resolution": [LEVELS[x][0] for x in level], "kept_tokens": np.ceil(pdf["tokens"] * share).astype("int64")})

    scores = block_scores(df, conv=conv, turn=turn)
    return scores.groupBy(conv).applyInPandas(run, f"{conv} {kinds[conv]}, {turn} {kinds[turn]}, resolution string, kept_tokens long")


def digest_aged(df: DataFrame, role: str = "tool", keep: int = 3, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """df with the text of all but the newest messages of a role cut to a line marked as pruned; already cut ones stay."""
    age = F.row_number().over(Window.partitionBy(conv, "role").orderBy(F.desc(turn)))
    line = F.concat(F.lit("[aged-pruned] "), F.substring(F.substring_index("text", "\n", 1), 1, 80))
    old = (F.col("role") == role) & (age > keep) & ~F.col("text").startswith("[aged-pruned]")
    return df.withColumn("text", F.when(old, line).otherwise(F.col("text")))


def block_skeleton(role: Column, text: Column) -> Column:
    """A block in short: of an assistant's its first two sentences and the last; others stay."""
    parts = F.filter(F.split(text, r"[.\n]", -1), lambda s: F.octet_length(F.trim(s)) > 5)
    ends = F.concat(F.trim(F.get(parts, F.lit(0))), F.lit(". "), F.trim(F.get(parts, F.lit(1))), F.lit(". [...] "), F.trim(F.element_at(parts, -1)))
    short = F.when(F.size(parts) <= 3, F.substring(text, 1, 300)).otherwise(ends)
    return F.when(text == "", F.concat(F.lit("[empty "), role, F.lit("]"))).when(role == "assistant", short).otherwise(text)


def block_digest(role: Column, text: Column) -> Column:
    """A block in one line: its kind and how it begins."""
    first = F.substring(F.substring_index(text, "\n", 1), 1, 60)
    return F.when(text == "", F.concat(F.lit("[empty "), role, F.lit("]"))).otherwise(F.concat(F.lit("["), role, F.lit(": "), first, F.lit("...]")))
