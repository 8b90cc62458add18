"""Ranking of fragments for a question: BM25, TF-IDF, and what is built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_terms
from ..sources.shared import written

K1, B = 1.2, 0.75
#: Counts of terms in fragments that a task weighs for all questions.
TASK_COUNTS = 250_000


def bm25(df: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """Rows (key, matched, score) of the fragments that have one of the terms.

    Every text is tokenised once. Only the question's terms are exploded and counted; the corpus gives its
    number of texts, its mean length and the frequencies of these terms, a few rows in all.
    """
    wanted = sorted(set(terms))
    tokens = df.select(key, code_terms(F.col(text)).alias("t")).select(key, F.size("t").alias("len"), F.filter("t", lambda w: w.isin(*wanted)).alias("hits"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    tf = tokens.select(key, "len", F.explode("hits").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df_of = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df_of), "term").crossJoin(F.broadcast(stats))  # a row for each term, and one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("avg", F.lit(1.0))))
    out = joined.groupBy(key).agg(F.count("*").alias("matched"), F.sum(part).alias("base"))
    coverage = F.col("matched") / len(wanted)
    return out.select(key, "matched", (F.col("base") + F.pow(coverage, F.lit(1.5)) * 0.5 * F.col("base")).alias("score"))


def bm25_many(df: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text", k1: float = K1, b: float = B, most_terms: int = 500_000, terms: Callable[[Column], Column] = code_terms, coverage: float = 0.5, parts: bool = False) -> DataFrame:
    """Rows (item, key, matched, score): bm25() of every question of a table (item, question) at once, each over all fragments.

    Every text is tokenised once, and only terms that some question has are counted; counts are written. The questions' terms are
    broadcast up to most_terms rows, else joined by shuffle. A row for each question and fragment that share a
    term is made, so a question's cost is that of its terms' postings. Questions that repeat an item are one.
    terms makes an array of terms of a text; coverage is how much a question whose terms are all met gains.
    With parts, rows that repeat a key are parts of one text: their counts are added up, their texts never joined.
    """
    asked = written(questions.select(F.col(item).alias("_item"), F.explode(terms(F.col(question))).alias("term")).distinct(), "retrieval-asked")
    few = asked.count() <= most_terms
    small = lambda d: F.broadcast(d) if few else d
    wanted = asked.groupBy(F.col("_item").alias("_of")).agg(F.count("*").alias("wanted"))
    # a term of null stands for the text itself: sizes and counts come from one pass, and are written
    found = df.select(key, terms(F.col(text)).alias("t")).select(key, F.size("t").alias("len"), F.explode(F.array_append(F.coalesce("t", F.array().cast("array<string>")), F.lit(None))).alias("term"))
    met = asked.select(F.col("term").alias("_met")).distinct()
    if few:
        known = F.broadcast(met.unionByName(met.sparkSession.sql("select cast(null as string) as _met")))
        found = found.join(known, F.col("term").eqNullSafe(F.col("_met"))).drop("_met")
    else:
        found = found.join(met, F.col("term") == F.col("_met")).drop("_met").unionByName(found.where("term is null"))
    size = [] if parts else ["len"]
    counts = written(found.groupBy(key, *size, "term").agg(F.count("*").alias("tf"), F.sum("len").alias("_sum")), "retrieval-counts")
    texts, tf = counts.where("term is null"), counts.where("term is not null").drop("_sum")
    n, sized = (F.count("*"), F.count("_sum")) if parts else (F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.when(F.col("len").isNotNull(), F.col("tf"))))
    stats = texts.agg(n.alias("n"), (F.sum("_sum") / F.nullif(sized, F.lit(0))).alias("avg"))
    df_of = tf.groupBy("term").agg(F.count("*").alias("df"))
    # as many partitions as bound a task's sums, which are of a fragment and so stay in its partition
    tf = tf.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tf.count() // TASK_COUNTS + 1), key)
    tf = tf.join(texts.select(key, F.col("_sum").alias("len")), key) if parts else tf
    weights = asked.join(df_of, "term").join(wanted, F.col("_item").eqNullSafe(F.col("_of"))).select("_item", "term", "df", "wanted").crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("avg", F.lit(1.0))))
    out = tf.join(small(weights), "term").groupBy("_item", key, "wanted").agg(F.count("*").alias("matched"), F.sum(part).alias("base"))
    return out.select(F.col("_item").alias(item), key, "matched", (F.col("base") + F.pow(F.col("matched") / F.col("wanted"), F.lit(1.5)) * coverage * F.col("base")).alias("score"))


def min_max(df: DataFrame, score: str) -> DataFrame:
    """score brought to 0.05 ... 1; 0.5 if all are equal."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = F.greatest(F.lit(0.05), F.least(F.lit(1.0), (F.col(score) - F.col("lo")) / span * 0.95 + 0.05))
    return df.crossJoin(F.broadcast(ends)).withColumn(score, F.when(span < 1e-10, 0.5).otherwise(scaled)).drop("lo", "hi")


def rank_percentile(df: DataFrame, score: str, key: str) -> DataFrame:
    """0.95 * (1 - rank / n) + 0.05, rank from 0 by descending score and then key.

    Ranks come from the sizes of sorted partitions, not from one window over all rows.
    """
    ordered = df.repartitionByRange(F.desc(score), F.asc(key)).sortWithinPartitions(F.desc(score), F.asc(key)).withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    rank = F.col("place") + F.col("before")
    return ordered.join(F.broadcast(before), "part").withColumn("percentile", F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.95 * (1 - rank / F.col("all")) + 0.05))).drop("at", "part", "place", "before", "all")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's key, its different terms and how often it has them."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        coded = lists.flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        kinds, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + np.asarray(coded.indices, np.int64), return_counts=True)
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(kinds // n, minlength=len(sizes)))]).astype(np.int32))
        terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(kinds % n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), terms, pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int64)))], names=["key", "terms", "tfs"])


def tfidf_cosine(df: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", least: float = 0.01, most_terms: int = 2_000_000) -> DataFrame:
    """Rows (key, cosine) of raw term frequencies weighted by ln((n + 1) / (df + 1)) + 1, over a least value.

    Texts are tokenised once, and a text's counts are written as one row. Weights are broadcast up to most_terms
    terms, so that counts stay where they are and only a text's sums are shuffled; more are joined by shuffle.
    Rows that repeat a key are one text, and then counts are shuffled.
    """
    n = df.agg(F.count("*").alias("n"))
    packed = written(df.select(F.col(key).alias("key"), code_terms(F.col(text)).alias("t")).mapInArrow(_term_counts, f"key {dict(df.dtypes)[key]}, terms array<string>, tfs array<bigint>"), "retrieval-terms")
    tf = packed.select(F.col("key").alias(key), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    if not packed.groupBy("key").count().where("count > 1").isEmpty():
        tf = tf.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    idf = written(idf, "retrieval-idf")
    few = idf.count() <= most_terms
    counts = {t: terms.count(t) for t in sorted(set(terms))}
    asked = F.create_map(*[x for t, c in counts.items() for x in (F.lit(t), F.lit(float(c)))])
    weighted = tf.join(F.broadcast(idf) if few else idf, "term").withColumn("w", F.col("tf") * F.col("idf")).withColumn("q", F.coalesce(F.element_at(asked, F.col("term")), F.lit(0.0)) * F.col("idf"))
    norm = idf.where(F.col("term").isin(*counts)).agg(F.sqrt(F.sum(F.pow(F.element_at(asked, F.col("term")) * F.col("idf"), F.lit(2.0)))).alias("qn"))
    dots = weighted.groupBy(key).agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    return dots.crossJoin(F.broadcast(norm)).select(key, (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("cosine")).where(F.col("cosine") > least)
