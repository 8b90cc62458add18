"""Whether code refers to what there is: a table of names, and how usual a name is for a code base by a model of its characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code_refs import WEIGHTS, ref_batches
from ..functions.grams import counter
from ..sources.shared import written

# --- fixed values: characters of a run, what each shorter run costs, unknown characters, the middle of surprise, names that are always there ---
N, BACKOFF, UNKNOWN, MIDDLE = 4, 0.4, -10.0, 6.5
GROUND = ("self", "cls", "args", "kwargs", "_", "__init__", "__str__", "__repr__", "main", "True", "False", "None")
START, END = "\x02", "\x03"


def _chars(text: Column, n: int) -> Column:
    """The characters of a text, with n - 1 marks before its start."""
    return F.regexp_extract_all(F.concat(F.lit(START * (n - 1)), text), F.lit("(?s)."), F.lit(0))


def _runs(chars: str, n: int) -> Column:
    """The runs of n that end at each character; chars is a column, so that a text is cut once and not for every run."""
    return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(n), F.size(chars)), lambda i: F.array_join(F.slice(chars, i - (n - 1), n), "")))


def train(texts: DataFrame, text: str, n: int = N) -> DataFrame:
    """Rows (gram, order, n, of): how often each run of 1 to n characters occurs, and its context, that is the run without the last one.

    Only the longest runs are counted over the texts, a chunk of a million characters at a time, so what is
    shuffled is a row for each different run of a chunk; shorter ones are sums of those that end with them.
    Null and empty texts have none.
    """
    some = texts.where(F.length(text) > 0).select(F.col(text).cast("string").alias("t"))
    longest = some.mapInPandas(counter(n, START, END), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("order"), F.right("gram", k).alias("gram"))))
    counts = longest.select(each.alias("g"), "n").groupBy("g.gram", "g.order").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("context", F.expr("left(gram, order - 1)"))
    contexts = counts.groupBy("order", "context").agg(F.sum("n").alias("of"))
    return counts.join(contexts, ["order", "context"]).select("gram", "order", "n", "of")


def surprisal(names: DataFrame, name: str, model: DataFrame, n: int = N) -> DataFrame:
    """Rows (name, surprisal): the mean of -ln p of a name's characters, each by the longest run that the model knows.

    A shorter run than n costs ln 0.4 for each character that it is shorter; a character that the model does not
    know counts 10. Different names are scored once, and what a run costs is looked up once for each different
    run. No side of these joins is broadcast: names are few bytes before they are cut to runs, so Spark would
    take the runs for a small table. The empty name has 0.
    """
    different = names.select(F.col(name).alias("_name")).where(F.col(name).isNotNull()).distinct()
    ends = different.select("_name", _chars(F.col("_name"), n).alias("_c")).select("_name", F.explode(_runs("_c", n)).alias("_gram"))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("order"), F.right("_gram", k).alias("gram"))))
    met = ends.select("_gram").distinct().select("_gram", each.alias("g")).select("_gram", "g.order", "g.gram").join(model.hint("merge"), ["order", "gram"])
    cost = F.log(F.col("n") / F.col("of")) + (n - F.col("order")) * F.log(F.lit(BACKOFF))
    known = met.groupBy("_gram").agg(F.max_by(cost, "order").alias("p"))
    sums = ends.join(known.hint("shuffle_hash"), "_gram").groupBy("_name").agg(F.sum("p").alias("p"), F.count("*").alias("known"))
    size = F.length("_name")
    mean = (F.coalesce("p", F.lit(0.0)) + UNKNOWN * (size - F.coalesce("known", F.lit(0)))) / F.greatest(size, F.lit(1))
    return different.join(sums.hint("merge"), "_name", "left").select(F.col("_name").alias(name), (-mean).alias("surprisal"))


def refs(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, name, kind, line, weight): every reference of every source."""
    rows = sources.select(key, text).mapInArrow(ref_batches, f"key {dict(sources.dtypes)[key]}, name string, kind string, line int").withColumnRenamed("key", key)
    weight = F.lit(None).cast("double")
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    return rows.withColumn("weight", weight)


def posterior(name: Column, there: Column, surprise: Column) -> Column:
    """The chance that a reference is to nothing: 0 for names that always are, 1 for one that nobody defines, else by how unusual it is."""
    always = name.isin(*GROUND) | name.rlike(r"^__[a-zA-Z_]+__$") | (F.length(name) <= 1)
    return F.when(always, 0.0).when(~there, 1.0).otherwise(1 / (1 + F.exp(-(surprise - MIDDLE))))


def verify(references: DataFrame, manifest: DataFrame, model: DataFrame, key: str, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(verdicts, scores): references with whether they are there, their surprisal and chance p; and for each key the chance h that any is to nothing.

    h is 1 less the product of (1 - p)^weight, a sum of logarithms. manifest has one column, name. References are
    found once and written. Names are looked up once each, and verdicts are joined back; a source without
    references has no score.
    """
    references = written(references, "symbols-references")
    names = references.select("name").distinct()
    known = manifest.select("name").distinct().withColumn("_there", F.lit(True))
    judged = names.join(known, "name", "left").join(surprisal(names, "name", model, n), "name").withColumn("resolved", F.coalesce("_there", F.lit(False)))
    always = F.col("name").isin(*GROUND) | F.col("name").rlike(r"^__[a-zA-Z_]+__$")
    judged = judged.select("name", (F.col("resolved") | always).alias("resolved"), "surprisal", posterior(F.col("name"), F.col("resolved"), F.col("surprisal")).alias("p"))
    verdicts = references.join(judged, "name")
    log = F.sum(F.col("weight") * F.log(1 - F.least(F.col("p"), F.lit(1 - 1e-12))))
    scores = verdicts.groupBy(key).agg((1 - F.exp(log)).alias("h"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(F.col("resolved") & (F.col("p") > 0.5)).alias("suspicious"))
    return verdicts, scores
