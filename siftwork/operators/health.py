"""Health of a corpus: anomalies by group, symbols, layers, names, agreement of beliefs, archetypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename_of, layer

MIN_GROUP, LIMIT, CONSISTENCY = 5, 2.5, 0.6745


def anomalies(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Rows (key, group, kind, z, confidence) whose distance to the group's median is 2.5 robust deviations or more.

    Two exact medians by group; groups under 5 rows, or without spread, have no anomalies. The medians, a row
    for each group, are joined back.
    """
    rows = df.select(key, group, value)
    mid = rows.groupBy(group).agg(F.median(value).alias("mid"), F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP)
    off = rows.join(mid, group).withColumn("off", F.abs(F.col(value) - F.col("mid")))
    mad = off.groupBy(group).agg(F.median("off").alias("mad")).where("mad >= 1e-9")
    z = CONSISTENCY * (F.col(value) - F.col("mid")) / F.col("mad")
    found = off.join(mad, group).withColumn("z", z).where(F.abs("z") >= LIMIT)
    confidence = 0.5 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.5 * F.least((F.abs("z") - LIMIT) / 2, F.lit(1.0))
    return found.select(key, group, F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind"), "z", confidence.alias("confidence"))


def dead_symbols(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, dead): words that occur in this text and no other."""
    from ..functions.text import words_of

    words = df.select(key, F.explode(F.array_distinct(words_of(F.col(text)))).alias("s"))
    once = words.groupBy("s").agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n = 1")
    return once.groupBy(key).agg(F.count("*").alias("dead"))


def god_files(edges: DataFrame) -> DataFrame:
    """Rows (id, deps) with more dependents than the mean and two deviations, and three at least."""
    deps = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deps"))
    top = deps.agg((F.avg("deps") + 2 * F.stddev_pop("deps")).alias("top"))
    return deps.crossJoin(F.broadcast(top)).where("deps > top and deps >= 3").select("id", "deps")


def layer_violations(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of df with (importer, imported, evidence): import lines that reach over a layer upwards; tests may."""
    line = F.lower("evidence")
    imports = line.startswith("import ") | line.startswith("from ") | line.startswith("use ") | line.contains("require(") | line.startswith("#include")
    rows = df.withColumn("importer", layer(F.col(path))).where("importer is not null and importer <> 5")
    rows = rows.withColumn("evidence", F.explode(F.split(content, "\n", -1))).where(imports).withColumn("imported", layer(F.col("evidence")))
    return rows.where("imported > importer + 1")


def naming_issues(df: DataFrame, key: str = "doc_id", path: str = "path") -> DataFrame:
    """Rows (key, path, expected) of files not named as their language has it."""
    stem = F.regexp_extract(basename_of(F.col(path)), r"([^/.]*)\.[^/.]*$", 1)
    snake = F.col(path).rlike(r"\.(py|rs)$") & stem.rlike("[A-Z]")
    pascal = F.col(path).rlike(r"\.(js|ts|jsx|tsx)$") & F.col(path).contains("/components/") & ~stem.rlike("^[A-Z]")
    expected = F.when(snake, "snake_case").when(pascal, "PascalCase")
    return df.where(F.length(stem) >= 3).select(key, path, expected.alias("expected")).where("expected is not null")


def code_health(coupling: Column, duplication: Column, dead: Column, arch: Column, naming: Column) -> Column:
    return 100 * (1 - (0.30 * coupling + 0.30 * duplication + 0.20 * dead + 0.15 * arch + 0.05 * naming))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def trimmed_mean(df: DataFrame, group: str, value: str, share: float = 0.1) -> DataFrame:
    """Rows (group, mean) without the tenth (one at least) at either end; groups under three keep all.

    What goes is found from the counts of equal values, summed over each group in order: distinct values
    are pre-aggregated, and repeated ones never gather in one task.
    """
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    placed = counts.withColumn("to", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    cut = F.when(F.col("n") < 3, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    kept = F.greatest(F.lit(0), F.least(F.col("to"), F.col("n") - cut) - F.greatest(F.col("to") - F.col("c"), cut))
    return placed.withColumn("k", kept).groupBy(group).agg((F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("mean"))


def contradictions(beliefs: DataFrame, gap: float = 0.4) -> DataFrame:
    """Rows (entity, low, high, pairs): confidences of beliefs on one entity that lie over the gap apart, and how many pairs these are.

    Beliefs on an entity with one confidence are counted together first, so that no entity's beliefs are paired one by one.
    """
    n = beliefs.groupBy("entity", "confidence").agg(F.count("*").alias("n"))
    a, b = n.alias("a"), n.alias("b")
    far = F.col("b.confidence") - F.col("a.confidence") > gap
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & far).select(F.col("a.entity").alias("entity"), F.col("a.confidence").alias("low"), F.col("b.confidence").alias("high"), (F.col("a.n") * F.col("b.n")).alias("pairs"))


def classify_by_centroid(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (key, archetype, confidence): the nearest class centroid, and how much nearer it is than the next.

    Centroids are one row of arrays, as many as there are classes, and are broadcast.
    """
    rows = df.select(key, label, F.col(vector).cast("array<double>").alias("v"))
    means = rows.select(label, F.posexplode("v").alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("m"))
    centroids = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    table = centroids.agg(F.collect_list(F.struct(F.col(label).alias("a"), "c")).alias("all"))
    distance = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    near = rows.crossJoin(F.broadcast(table)).withColumn("d", F.array_sort(F.transform("all", lambda s: F.struct(distance(s["c"]).alias("d"), s["a"].alias("a")))))
    first, second = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    confidence = F.when(F.greatest(first["d"], second["d"]) > 0, (second["d"] - first["d"]) / F.greatest(first["d"], second["d"])).otherwise(0.5)
    return near.select(key, first["a"].alias("archetype"), F.round(confidence, 6).alias("confidence"))
