"""Provenance, LSH candidates, and what is read from code: definitions, imports, skeletons."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from ..functions.constants import LSH_FLIPS, LSH_PLACES


def bit_key(value: Column, places: tuple[int, ...]) -> Column:
    """The bits at some places, as a number."""
    return reduce(lambda a, b: a + b, [F.shiftleft(F.shiftrightunsigned(value, p).bitwiseAND(1), k) for k, p in enumerate(places)])


def lsh_candidates(index: DataFrame, queries: DataFrame, key: str = "doc_id", flips: int = LSH_FLIPS) -> DataFrame:
    """Rows (query, candidate): ids that share a table's key with a query, its first bits flipped one at a time too."""
    places = LSH_PLACES
    filed = index.select(F.col(key).alias("candidate"), F.posexplode(F.array(*[bit_key(F.col("simhash"), p) for p in places])).alias("table", "slot"))
    probes = F.array(*[F.struct(F.lit(t).alias("table"), bit_key(F.col("simhash"), p).bitwiseXOR(F.lit(0 if f < 0 else 1 << f)).alias("slot")) for t, p in enumerate(places) for f in range(-1, flips)])
    asked = queries.select(F.col(key).alias("query"), F.inline(probes))
    return filed.join(asked, ["table", "slot"]).where("query <> candidate").select("query", "candidate").distinct()


def greedy_dedup(df: DataFrame, group: str, order: str, words: str, most: float) -> DataFrame:
    """Rows (group, order) kept: in order, those whose greatest Jaccard to a kept one is at most `most`."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept, rows = [], []
        for k, w in zip(pdf[order], pdf[words], strict=True):
            w = set(w)
            if all(len(w & v) <= most * len(w | v) or not (w | v) for v in kept):
                kept.append(w)
                rows.append(k)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(rows), order: rows})

    return df.select(group, order, words).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}")


@pandas_udf(DoubleType())
def grounded_share(texts: pd.Series, contexts: pd.Series) -> pd.Series:
    """The share of a text's identifier characters that lie in runs of three or more which its context has too.

    A character lies in such a run exactly if one of the three-character windows over it is in the context.
    """
    out = []
    for text, context in zip(texts, contexts, strict=True):
        known = {context[k : k + 3] for k in range(len(context) - 2)}
        hits = [text[k : k + 3] in known for k in range(len(text))]
        spots = [k for m in re.finditer(r"\w{2,}", text) for k in range(*m.span())]
        out.append(sum(any(hits[max(0, k - 2) : k + 1]) for k in spots) / len(spots) if spots else 1.0)
    return pd.Series(out)


def quote_support(quote: Column, context: Column) -> Column:
    return F.when((quote == "") | ~context.contains(quote), 0.0).when(F.octet_length(quote) > 80, 0.95).otherwise(0.82)


def slot_support(numbers: Column, entities: Column, adequacy: Column, tokens: Column) -> Column:
    """Support by slots: only where all numbers and most entities are there."""
    return F.when((numbers == 1) & (entities >= 0.65), F.least(0.25 + 0.35 * adequacy + 0.20 * tokens, F.lit(0.74))).otherwise(0.0)


DEFINED = [re.compile(p, re.M) for p in (r"^\s*(?:async\s+)?def\s+(\w+)", r"^\s*class\s+(\w+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)", r"^\s*(?:export\s+)?const\s+(\w+)\s*[:=]", r"^\s*(?:export\s+)?interface\s+(\w+)")]
IMPORTED = [re.compile(p, re.M) for p in (r"^\s*import\s+([\w.]+)\s*$", r"^\s*from\s+([\w.]+)\s+import", r"^\s*use\s+([\w:]+)", r"require\(\s*['\"]([^'\"]+)['\"]", r"^\s*import\s.*?from\s+['\"]([^'\"]+)['\"]", r"^\s*#include\s+[<\"]([^>\"]+)[>\"]")]


def _found(patterns):
    @pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({m for p in patterns for m in p.findall(t or "")}))

    return run


definitions, imports = _found(DEFINED), _found(IMPORTED)

HEADS = {
    "python": re.compile(r"\s*(?:@|import\s|from\s|class\s|(?:async\s+)?def\s|[A-Z_]+\s*=)"),
    "rust": re.compile(r"\s*(?:#\[|use\s|mod\s|pub\s|fn\s|struct\s|enum\s|trait\s|impl\b|type\s|const\s|static\s)"),
    "go": re.compile(r"(?:package\s|import\s|func\s|type\s|var\s|const\s)"),
    "javascript": re.compile(r"\s*(?:import\s|export\s|class\s|(?:async\s+)?function\s|const\s+\w+\s*=\s*(?:async\s*)?\()"),
    "java": re.compile(r"\s*(?:@|package\s|import\s|(?:public|private|protected|abstract|final|static)\s|class\s|interface\s)"),
    "css": re.compile(r"[^\s{}][^{}]*\{"),
}


def outline(text: str, language: str) -> str | None:
    """The heads of a source's definitions; None if that is no shorter by a third, or the language has no rule."""
    heads, lines = HEADS.get(language), text.split("\n")
    if heads is None or len(lines) < 5:
        return None
    out = []
    for line in lines:
        if heads.match(line):
            bare = line.rstrip()
            out.append(bare + " ..." if bare.endswith((":", "{")) else bare)
    short = "\n".join(out)
    return short if 10 <= len(short) <= 0.7 * len(text) else None


@pandas_udf(StringType())
def skeleton(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else outline(t, g) for t, g in zip(texts, languages, strict=True)], dtype=object)


def _trigrams(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").encode(), np.uint8).astype(np.int64)
    return b[:-2] * 1099511628211 ^ b[1:-1] * 16777619 ^ b[2:] if len(b) > 2 else np.zeros(0, np.int64)


@pandas_udf(ArrayType(LongType()))
def byte_trigrams(texts: pd.Series) -> pd.Series:
    """Hashes of every three bytes of a text, by fixed multipliers."""
    return pd.Series([_trigrams(t) for t in texts])


@pandas_udf(LongType())
def trigram_total(texts: pd.Series) -> pd.Series:
    """The sum of byte_trigrams modulo 2^64, as a signed long: some 33,000 of them may pass 2^63."""
    return pd.Series([int(_trigrams(t).sum()) for t in texts], dtype="int64")


def char_ngrams(df: DataFrame, text: str, n: int) -> DataFrame:
    """Rows (g, n): how often each run of n characters occurs."""
    size = F.length(text)
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return df.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
