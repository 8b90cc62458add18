"""Dependency graphs as tables of edges (src, dst, strength): ranks, reach, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written


def checkpoint_ready(spark: SparkSession) -> None:
    """Gives checkpoint() the shared folder where the session has set none: of a local session's own, or an error."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 15, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Rows (id, rank). Rank of nodes without edges out is spread over all; edges to other ids lose theirs.

    Lineage is cut by checkpoint() every few rounds, in the folder that all executors share.
    """
    spark = nodes.sparkSession
    checkpoint_ready(spark)
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = edges.join(out, "src").select("src", "dst", "out")
    base = nodes.join(out, nodes.id == out.src, "left").select("id", F.col("out").isNull().alias("dangling"))
    ranks = base.withColumn("rank", F.lit(1.0 / max(1, n)))
    for k in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        share = (1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)
        ranks = base.join(given, "id", "left").crossJoin(F.broadcast(lost)).select("id", "dangling", share.alias("rank"))
        if k % every == every - 1 and k < rounds - 1:
            ranks = ranks.checkpoint()
    return ranks.select("id", "rank")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """Rows (id, depth): what the seeds (column id) reach within so many edges, at the least depth; seeds at 0.

    Each layer is written, and edges are read again for the next: only those that touch the layer before go on,
    so edges may be repeated and are never sorted, shuffled or made distinct as a whole where a layer is small.
    """
    step = edges.select("src", "dst")
    if both_ways:
        step = edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    layers = [written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "reach-layer")]
    for d in range(1, depth + 1):
        near = step.join(layers[-1].select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
        layers.append(written(near.distinct().withColumn("depth", F.lit(d)), "reach-layer"))
    return reduce(DataFrame.unionByName, layers).groupBy("id").agg(F.min("depth").alias("depth"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (id, component): the smallest id that each id is connected to, over edges in either direction.

    Labels spread to neighbours and are then followed once, until nothing changes; each round is a
    checkpoint() in the shared folder.
    """
    checkpoint_ready(edges.sparkSession)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    ids = both.select(F.col("src").alias("id")).distinct()
    if nodes is not None:
        ids = ids.unionByName(nodes.select("id")).distinct()
    labels = ids.withColumn("label", F.col("id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")).checkpoint()
        nxt = low.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = low.join(nxt, "label", "left").select("id", "was", F.least("label", "next").alias("label")).checkpoint()
        labels = after.select("id", "label")
        if after.where("label <> was").isEmpty():
            return labels.select("id", F.col("label").alias("component"))


def dependency_boosts(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows (id, boost): strength of the edges from chosen ids, over the greatest."""
    total = edges.join(chosen.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.sum("strength").alias("boost"))
    top = total.agg(F.max("boost").alias("top"))
    return total.crossJoin(F.broadcast(top)).select("id", (F.col("boost") / F.col("top")).alias("boost"))


def symbol_edges(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Edges (src, dst): from a reference (id, seq, symbol) to the latest definition (id, seq, symbol) before it.

    An as-of join by one window over the union of both, partitioned by symbol.
    """
    from pyspark.sql import Window

    both = definitions.select("symbol", "seq", F.col("id").alias("def_id"), F.lit(None).cast("long").alias("ref_id")).unionByName(references.select("symbol", "seq", F.lit(None).cast("long").alias("def_id"), F.col("id").alias("ref_id")))
    w = Window.partitionBy("symbol").orderBy("seq", F.col("ref_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("dst", F.last("def_id", ignorenulls=True).over(w))
    return found.where("ref_id is not null and dst is not null and dst <> ref_id").select(F.col("ref_id").alias("src"), "dst", "symbol").distinct()
