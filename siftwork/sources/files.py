"""Sources and sinks: project files, event logs, checkpoints, notes, diagrams, diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename_of, token_count

INDEXED = (".py", ".rs", ".go", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".cs", ".rb", ".php", ".swift", ".c", ".h", ".cpp", ".hpp", ".sql", ".md", ".toml", ".yaml", ".yml", ".json", ".sh", ".html", ".css", ".vue", ".proto", ".tf")
HOT, COLD = ("src", "lib", "app", "core", "pkg", "internal"), ("vendor", "node_modules", "dist", "build", "archive", "deprecated")


def read_project(spark: SparkSession, path: str, ignore: tuple[str, ...] = (), max_bytes: int = 500_000) -> DataFrame:
    """Fragments (source, content, bytes, tokens) of the indexed files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("source"), F.col("length").alias("bytes"), "content").where(should_index(F.col("source")) & (F.col("bytes") <= max_bytes) & ~ignored(F.col("source"), ignore))
    rows = rows.withColumn("content", F.decode("content", "UTF-8"))
    return rows.withColumn("tokens", token_count(F.col("content")))


def glob_pattern(glob: str) -> str:
    """A regex for a glob of an ignore file: * stays within a folder, ** does not."""
    out = ""
    for k, part in enumerate(glob.rstrip("/").split("**")):
        out += (".*" if k else "") + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else f"\\{c}" if c in ".+()[]{}^$|\\" else c for c in part)
    return f"(^|/){out}($|/)"


def ignored(path: Column, globs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))


def should_index(path: Column) -> Column:
    base = F.lower(basename_of(path))
    return reduce(lambda a, b: a | b, [base.endswith(e) for e in INDEXED]) | base.isin("dockerfile", "makefile")


def priority(path: Column) -> Column:
    """The order of indexing, 0 to 100: hot folders first, cold ones last, tests below sources."""
    low = F.concat(F.lit("/"), F.lower(path))
    within = lambda names: reduce(lambda a, b: a | b, [low.contains(f"/{n}/") for n in names])
    return F.when(within(COLD), 5).when(low.contains("test"), 40).when(within(HOT), 90).when(low.endswith(".md"), 30).otherwise(60)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """Rows (key, change): added, deleted or changed between two snapshots."""
    o, n = old.select(key, F.col(hash_).alias("was")), new.select(key, F.col(hash_).alias("now"))
    both = o.join(n, key, "full")
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").alias("change")).where("change is not null")


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON-lines log; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def merge_peers(frames: list[DataFrame], key: str, turn: str, count: str) -> DataFrame:
    """One row of each key: the newest turn, then the highest count, then the first frame's. By partial aggregation."""
    rows = reduce(lambda a, b: a.unionByName(b), [f.withColumn("_peer", F.lit(-k)) for k, f in enumerate(frames)])
    rest = [c for c in frames[0].columns if c not in (key, turn, count)]
    best = rows.groupBy(key).agg(F.max(F.struct(turn, count, "_peer", *rest)).alias("m"))
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in frames[0].columns if c != key])


def newest(df: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The rows beyond the newest few of each group: what a clean-up deletes."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).drop("_r")


def frontmatter(text: Column, name: str) -> Column:
    """A value of a note's head between --- lines."""
    return F.trim(F.regexp_extract(text, rf"(?ms)\A---\n(?:.*?\n)??{name}:\s*([^\n]*)\n.*?^---$", 1))


def diagram_edges(text: Column) -> Column:
    """An array of (src, dst) from the arrows of a diagram's text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\w+)\s*-+>\s*(?:\|[^|]*\|)?\s*(\w+)"), F.lit(0)), lambda e: F.struct(F.regexp_extract(e, r"^(\w+)", 1).alias("src"), F.regexp_extract(e, r"(\w+)$", 1).alias("dst")))


def diff_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, hunk, added, removed) of unified diffs; hunks are numbered from 1, lines before any are left out."""
    lines = F.split(text, "\n", -1)
    rows = df.select(key, F.posexplode(lines).alias("i", "line")).withColumn("starts", F.col("line").startswith("@@").cast("int"))
    from pyspark.sql import Window

    hunk = F.sum("starts").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hunk", hunk).where("hunk > 0")
    sign = lambda c: F.count_if(F.col("line").startswith(c) & ~F.col("line").startswith(c * 3))
    return rows.groupBy(key, "hunk").agg(sign("+").alias("added"), sign("-").alias("removed"))


def write_notes(df: DataFrame, folder: str) -> DataFrame:
    """Notes (one column of texts) written as records, and read back: a note may have many lines."""
    import uuid

    path, name = f"{folder}-{uuid.uuid4().hex}", df.columns[0]
    df.write.option("lineSep", "\x00").text(path)
    return df.sparkSession.read.option("lineSep", "\x00").text(path).select(F.col("value").alias(name))


def round_trip_json(df: DataFrame, folder: str) -> DataFrame:
    """df written as JSON lines, and read back under its schema."""
    import uuid

    path = f"{folder}-{uuid.uuid4().hex}"
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def save_snapshot(df: DataFrame, folder: str) -> str:
    """df written as a Parquet snapshot of its own; its path."""
    import uuid

    path = f"{folder}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_checkpoint(df: DataFrame, folder: str, number: int) -> str:
    """df as compressed JSON under a numbered folder, which appears whole or not at all."""
    path = f"{folder}/checkpoint={number:08d}"
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    return path


def load_latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the checkpoint of the greatest number: a partition filter, the others are not read."""
    every = spark.read.schema(f"{schema}, checkpoint int").option("basePath", folder).json(folder)
    last = every.select("checkpoint").distinct().agg(F.max("checkpoint")).first()[0]
    return every.where(F.col("checkpoint") == last).drop("checkpoint")


# --- fixed values: names and folders of a project's descriptions ---
DOC_NAMES = ("README", "ARCHITECTURE", "CONTRIBUTING", "CHANGELOG", "DESIGN", "API", "OVERVIEW", "GUIDE", "SETUP", "DEPLOY")
DOC_FOLDERS = ("docs", "doc", "documentation", "wiki")


def compile_docs(df: DataFrame, path: str, text: str) -> DataFrame:
    """The rows of df that describe a project, with entity, title, sections and words.

    These are Markdown files at the top whose name begins with one that is usual, and all below a folder for
    documents. The title is the first heading, else the name; sections are headings of the second and third
    order; files without text are left out.
    """
    stem = F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    top = ~F.col(path).contains("/") & F.upper(stem).rlike(f"^({'|'.join(DOC_NAMES)})")
    rows = df.where(F.lower(path).endswith(".md") & (top | F.lower(path).rlike(f"^({'|'.join(DOC_FOLDERS)})/")) & (F.trim(text) != ""))
    lines = F.split(text, "\n", -1)
    title = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    return rows.withColumns({
        "entity": F.concat(F.lit("doc/"), F.lower(stem)), "title": F.coalesce(F.trim(F.substring(title, 3, 1 << 30)), F.lower(stem)),
        "sections": F.transform(F.filter(lines, lambda x: x.startswith("## ") | x.startswith("### ")), F.trim), "words": F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))),
    })
