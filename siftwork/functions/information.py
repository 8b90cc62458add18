"""Information content of texts: entropies of bytes, DEFLATE sizes, and the scores made of them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType


def _histograms(texts: pd.Series):
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8) if t else np.zeros(0, np.uint8)
        counts = np.bincount(data, minlength=256)
        yield counts[counts > 0] / max(1, len(data))


@pandas_udf(DoubleType())
def shannon_entropy(texts: pd.Series) -> pd.Series:
    """Bits per byte of the histogram of bytes; 0 for empty texts."""
    return pd.Series([float(-(p * np.log2(p)).sum()) if len(p) else 0.0 for p in _histograms(texts)])


@pandas_udf(DoubleType())
def renyi_entropy_2(texts: pd.Series) -> pd.Series:
    """The collision entropy of the histogram of bytes."""
    return pd.Series([float(-np.log2((p * p).sum())) if len(p) else 0.0 for p in _histograms(texts)])


def _deflated(data: bytes) -> int:
    if len(data) < 8:
        return len(data)
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    return len(c.compress(data)) + len(c.flush())


@pandas_udf(LongType())
def compressed_size(texts: pd.Series) -> pd.Series:
    return pd.Series([_deflated((t or "").encode()) for t in texts])


@pandas_udf(DoubleType())
def ncd_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """1 less the normalised compression distance."""
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = (a or "").encode(), (b or "").encode()
        cx, cy = _deflated(x), _deflated(y)
        distance = (_deflated(x + b"\0" + y) - min(cx, cy)) / max(cx, cy, 1)
        out.append(1.0 - min(1.0, max(0.0, distance)))
    return pd.Series(out)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def kolmogorov_entropy(text: Column) -> Column:
    """The DEFLATE ratio from 0.10 to 0.80 on a scale from 0 to 1; 0.5 for texts under 32 bytes."""
    size = F.octet_length(text)
    return F.when(size < 32, 0.5).otherwise(clamp((compressed_size(text) / size - 0.10) / 0.70))


def normalized_entropy(h: Column) -> Column:
    return F.least(h / 6.0, F.lit(1.0))


def bits_per_byte(h: Column) -> Column:
    return clamp(h / 8.0)


def bpb_quality(bpb: Column, redundancy: Column) -> Column:
    return clamp(0.6 * bpb + 0.4 * (1.0 - redundancy))


def entropy_divergence(h1: Column, h2: Column) -> Column:
    return F.greatest(h1 - h2, F.lit(0.0))


def information_score(h1: Column, h2: Column, boilerplate: Column, redundancy: Column) -> Column:
    div = entropy_divergence(h1, h2)
    noise = F.when(div > 1.5, F.least(div - 1.5, F.lit(1.0)) * 0.15).otherwise(0.0)
    return clamp(0.40 * normalized_entropy(h1) + 0.30 * (1.0 - boilerplate) + 0.30 * (1.0 - redundancy) - noise)


def mass_factor(tokens: Column) -> Column:
    """0.3 + 0.7 times the logistic function of ln(tokens / 80)."""
    return 0.3 + 0.7 / (1.0 + F.exp(-F.log(tokens / 80.0)))


def renyi_alpha(values: Column, alpha: float) -> Column:
    """Renyi entropy of an array of scores, made shares of their sum; negative ones and zeros do not count."""
    positive = F.filter(values, lambda v: v > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, v: a + v)
    p = F.transform(positive, lambda v: v / total)
    if abs(alpha - 1.0) < 1e-9:
        out = F.aggregate(p, F.lit(0.0), lambda a, v: a - v * F.log2(v))
    elif alpha > 100:
        out = -F.log2(F.array_max(p))
    else:
        out = F.log2(F.aggregate(p, F.lit(0.0), lambda a, v: a + F.pow(v, F.lit(float(alpha))))) / (1.0 - alpha)
    return F.when(F.size(positive) == 0, 0.0).otherwise(out)


def ebbinghaus(turns: Column, half_life: Column) -> Column:
    """Recency after so many turns (negative ones count as 0)."""
    return F.exp(-F.log(F.lit(2.0)) / F.greatest(half_life, F.lit(1)) * F.greatest(turns, F.lit(0)))
