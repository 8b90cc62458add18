"""Mixing sources to target weights (10): Poisson replication of documents, then a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Sources up to which the table of rates is broadcast; with more it is joined by shuffle, with salt.
BROADCAST_SOURCES, SALT = 20_000, 32
#: A larger mean is drawn as the sum of equal parts of at most this mean, which has the same distribution.
PART = 32.0
SEED, ALPHA = 17, 0.5
#: Characters for a partition of the shuffled rows, and how few or many partitions there are.
PART_SIZE, LEAST_PARTS, MOST_PARTS = 64_000_000, 32, 100_000


def uniform(*parts) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """Rows (source, size, rate, parts, cdf): the mean number of copies of each document of a source.

    Sizes are characters. The target share of a source is its weight (column weight of weights) over the sum
    of weights, or with no weights given its size to the power alpha over their sum; the mixture is as large
    as the input. Weights of a source that is named twice add up; negative ones count as 0, and where all are
    0 every rate is 0. A source without a weight has none (rate 0); one without characters keeps rate 1. cdf
    holds the cumulative Poisson probabilities of one part of the mean.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length("text")).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.coalesce("size", F.lit(0)).cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("of")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = sizes.agg(F.sum("size").cast("double").alias("all"), F.sum("weight").alias("weights"))
    out = sizes.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.coalesce("size", F.lit(0)) > 0, F.coalesce(F.col("weight") / F.nullif("weights", F.lit(0.0)), F.lit(0.0)) * F.col("all") / F.nullif("size", F.lit(0))).otherwise(1.0)
    out = out.select("source", F.coalesce("size", F.lit(0)).alias("size"), rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int"))
    first = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        steps,
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("mean") / k)).alias("c")),
        lambda acc: acc["c"],
    )
    return out.select("source", "size", "rate", "parts", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs, each row repeated a Poisson number of times of its source's rate, in a global random order.

    The number of copies inverts the Poisson distribution at a uniform hash of (seed, doc_id, part), so it is
    the same however the data are laid out. Rows without a doc_id are drawn by a hash of their text instead;
    rows that repeat one have the same number. Two columns are added: copy (from 0) and shuffle_key, a hash
    whose ranges are the partitions and by which rows are sorted in them. As hashes are spread evenly, the
    ranges need no sample of the rows. Null sources are a source of their own; null texts have no size but are
    copied; an empty table gives an empty result. Columns of docs with the names of the new ones are replaced.
    """
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    docs = docs.select(*columns)
    table = written(rates(docs, weights, alpha).select(F.col("source").alias("of"), "size", "parts", "cdf"), "rates")
    n_sources, size = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    table = table.drop("size")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    if n_sources <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = docs.withColumn("pepper", F.pmod(F.xxhash64(*columns), F.lit(SALT))).join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("pepper") == F.col("salt")))
    draws = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda acc, j: acc + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), name, j))))
    copies = joined.withColumn("copies", draws).where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), name, F.col("copy"))))
    n = min(MOST_PARTS, max(LEAST_PARTS, -(-size // PART_SIZE)))
    part = F.shiftright(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(n), 32).cast("int")
    return keyed.repartitionById(n, part).sortWithinPartitions("shuffle_key", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "copy", "shuffle_key", F.md5("text").alias("text_md5"))


SQL = f"""
WITH RECURSIVE s AS (SELECT source, sum(length(text))::BIGINT AS size, pow(coalesce(sum(length(text)), 0)::DOUBLE, {ALPHA}) AS weight FROM documents GROUP BY source),
t AS (SELECT sum(size)::DOUBLE AS total, sum(weight) AS weights FROM s),
r AS (SELECT source, CASE WHEN coalesce(size, 0) > 0 THEN weight / weights * total / size ELSE 1.0::DOUBLE END AS rate FROM s, t),
m AS (SELECT source, greatest(1, ceil(rate / {PART})::INT) AS parts, rate / greatest(1, ceil(rate / {PART})::INT) AS mean FROM r),
c AS (SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM m
 UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
d AS (SELECT row_number() OVER () AS r, doc_id, text, source, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS name FROM documents),
u AS (SELECT d.r, ('0x' || substr(md5('{SEED}:' || name || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u, d.source
 FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(0, m.parts)) AS x(j)),
n AS (SELECT u.r, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.r)
SELECT doc_id, source, copy::INT AS copy, md5('order:{SEED}:' || name || ':' || copy) AS shuffle_key, md5(text) AS text_md5
FROM d JOIN n USING (r), unnest(range(0, n.copies)) AS y(copy)"""
