"""Keeps an index of fragments fresh: takes the files that came since the last run, and brings the index up to them.

    python -m jobs.refresh_index --source /data/documents.parquet --out /data/index

A run reads only files that no run before it has read, by a file stream over what there is; its checkpoint, all
changes and the index are below the folder of the output. A run that failed, or is repeated, ends with the same
index. The index has one row a document, partitioned by bucket: size in tokens, digests of the text and of its
words, entropy, share of boilerplate, and whether it holds a secret, which is what selection weighs.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from siftwork.functions import information as I
from siftwork.functions import text as X
from siftwork.operators.dedup import content_hash
from siftwork.plans import ORACLES
from siftwork.plans.scalars import BOILER, BYTES
from siftwork.sources.shared import new_path
from siftwork.streaming.watch import BATCH, Watch

from .common import command, defaults

log = logging.getLogger("jobs.refresh_index")


def described(text: Column) -> dict[str, Column]:
    """What the index has of a document; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return {
        "source": F.col("source"), "lang": F.col("lang"), "tokens": X.token_count(text), "digest": F.md5(text), "content": content_hash(text),
        "entropy": F.round(I.normalized_entropy(I.shannon_entropy(text)), 6), "boilerplate": F.round(X.boilerplate_ratio(text), 6), "unsafe": X.has_safety_signal(text),
    }


def watch(spark: SparkSession, config: dict) -> Watch:
    return Watch(spark, config["source"], config["out"], described(F.col(config["text"])), config["key"], config["deleted"], config["buckets"])


def refresh(spark: SparkSession, config: dict) -> DataFrame:
    """Brings the index in config["out"] up to the files in config["source"], and returns it."""
    began, w = time.time(), watch(spark, config)
    taken = w.follow(config["files_per_batch"])
    log.info("read %d rows of %s in %d batches, new since the last run", taken["rows"], config["source"], taken["batches"])
    counts = {r[BATCH]: r["count"] for r in w.index(marks=True).groupBy(BATCH).count().collect()}  # a row a batch
    log.info("%s/index: %d documents of %d batches, in %.1f s", config["out"], sum(counts.values()), len(counts), time.time() - began)
    return w.index()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job run twice over the documents, into one new folder: the second run finds nothing new."""
    config = defaults("refresh_index") | {"source": f"{sf_dir}/documents.parquet", "out": new_path(spark, "job1-refresh-index")}
    refresh(spark, config)
    return refresh(spark, config)


SQL = f"""
WITH {BYTES}, s AS ({ORACLES["flt2_has_safety_signal"]}), w AS ({ORACLES["join2_content_hash"]})
SELECT doc_id, source, lang, greatest(1, octet_length(encode(text)) // 4) AS tokens, md5(text) AS digest, hash AS content, round(least(h1 / 6, 1.0), 6) AS entropy,
 round({BOILER}, 6)::DOUBLE AS boilerplate, signal AS unsafe
FROM (SELECT doc_id, source, lang FROM documents) JOIN e USING (doc_id) JOIN s USING (doc_id) JOIN w USING (doc_id)"""


if __name__ == "__main__":
    command("refresh_index", refresh)
