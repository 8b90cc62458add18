"""Notes, beliefs, recipes and budgets: joins and aggregates over what is known of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ridge(df: DataFrame, x: str, y: str, weight: float) -> DataFrame:
    """One row (intercept, slope, n, error): y by x with a penalty on the slope, from sums; error is the standard error of the estimate."""
    s = df.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"))
    slope = F.col("xy") / (F.col("xx") + weight / F.col("n"))
    s = s.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    left = F.greatest(F.lit(0.0), F.col("yy") - 2 * F.col("slope") * F.col("xy") + F.col("slope") * F.col("slope") * F.col("xx"))
    return s.select("intercept", "slope", "n", F.sqrt(left / F.col("n")).alias("error"))


def predict_budget(model: DataFrame, df: DataFrame, x: str, cold: float = 0.20, most_error: float = 0.10, ceiling: float = 0.95) -> DataFrame:
    """df with budget: the model's estimate within 0.05 and the ceiling; the cold start where the model is unsure. One row is broadcast."""
    fit = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("intercept") + F.col("slope") * F.col(x)))
    return df.crossJoin(F.broadcast(model)).withColumn("budget", F.least(F.lit(ceiling), F.when(F.col("error") > most_error, cold).otherwise(fit))).drop("intercept", "slope", "n", "error")


def policy_gradient(df: DataFrame, features: list[str], reward: Column, chance: Column) -> DataFrame:
    """One row: for each feature the sum of (reward - mean reward) (1 - chance) feature."""
    means = df.agg(F.avg(reward).alias("_mean"))
    rows = df.crossJoin(F.broadcast(means))
    return rows.agg(*[F.sum((reward - F.col("_mean")) * (1 - chance) * F.col(f)).alias(f) for f in features])


def inject(fragments: DataFrame, beliefs: DataFrame, stem: Column) -> DataFrame:
    """fragments with the belief on the stem of their path, where there is one: an equi-join on the stem."""
    return fragments.withColumn("stem", stem).join(beliefs, "stem", "left")


def scaffold(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows (src, dst, symbol): which source uses what another defines, by an equi-join on the symbol."""
    return imports.join(definitions, "symbol").where("src <> dst").distinct()


def broken_links(notes: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Rows (key, link): links of notes to names that are not known."""
    links = notes.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), F.lit(1)))).alias("link"))
    return links.join(names, "link", "left_anti")


def consolidate(pairs: DataFrame, nodes: DataFrame, key: str, order: list) -> DataFrame:
    """Rows (key, winner): each node with the best of the nodes it is linked to and itself, by `order` columns of nodes, greatest first."""
    both = pairs.select(F.col("a").alias(key), F.col("b").alias("other")).union(pairs.select("b", "a")).union(nodes.select(F.col(key), F.col(key)))
    worth = nodes.select(F.col(key).alias("other"), F.struct(*order, (-F.col(key)).alias("last")).alias("worth"))
    return both.join(worth, "other").groupBy(key).agg((-F.max("worth")["last"]).alias("winner"))


def spend(tree: DataFrame, key: str, parent: str, share: str, budget: float, depth: int) -> DataFrame:
    """Rows (key, level, budget): what a tree of agents gets, each a share of its parent's; a join for each level."""
    level = tree.where(F.col(parent).isNull()).select(F.col(key), F.lit(0).alias("level"), (F.lit(budget) * F.col(share)).alias("budget"))
    out = level
    for k in range(1, depth + 1):
        above = level.select(F.col(key).alias("above"), F.col("budget").alias("given"))
        level = tree.join(above, F.col(parent) == F.col("above")).select(F.col(key), F.lit(k).alias("level"), (F.col("given") * F.col(share)).alias("budget"))
        out = out.unionByName(level)
    return out


def best_recipe(queries: DataFrame, query: str, recipes: DataFrame) -> DataFrame:
    """Rows of queries with the fittest recipe whose pattern they match; recipes that miss over half their parts are out. Recipes are few and broadcast."""
    usable = recipes.where("missing <= 0.5")
    hit = queries.join(F.broadcast(usable), F.expr(f"rlike({query}, pattern)"))
    keys = queries.columns
    return hit.groupBy(*keys).agg(F.max_by("recipe", F.struct("fitness", "recipe")).alias("recipe"))


def invalidate(entries: DataFrame, key: str, changes: DataFrame, at: str, most: int = 3) -> DataFrame:
    """entries with quality decayed by exp(-ln 2 * sum(1 / depth) / n) of the changes they depend on; over `most` changes it halves once more."""
    hits = changes.groupBy(key).agg(F.sum(1 / F.col(at)).alias("weight"), F.count("*").alias("n"))
    rows = entries.join(hits, key, "left")
    decay = F.when(F.col("n").isNull(), 1.0).otherwise(F.exp(-F.log(F.lit(2.0)) * F.col("weight") / F.col("n")))
    return rows.withColumn("quality", F.col("quality") * decay * F.when(F.coalesce("n", F.lit(0)) > most, 0.5).otherwise(1.0)).drop("weight", "n")


def admitted(entries: DataFrame, group: str, worth: str, key: str, room: int) -> DataFrame:
    """What a cache with room for so many entries a group keeps: those of most worth."""
    w = Window.partitionBy(group).orderBy(F.desc(worth), F.asc(key))
    return entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= room).drop("_r")


def level_of_detail(load: Column) -> Column:
    return F.when(load >= 0.9, "minimal").when(load >= 0.7, "reduced").when(load >= 0.4, "standard").otherwise("full")


def confusion(truth: Column, said: Column) -> list[Column]:
    """Counts tp, fp, fn, tn."""
    return [F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")]


def continuous_risk(features: dict[str, tuple[Column, float]], gates: tuple[str, ...], bias: float = 6.0) -> Column:
    """1 less the chance to survive: a logistic part of the positive features, and a gate for each negative one that has one."""
    z, open_ = F.lit(bias), F.lit(1.0)
    for name, (value, weight) in features.items():
        shut = (value < 0) & F.lit(name in gates)
        z = z + F.when(shut, 0.0).otherwise(weight * F.greatest(value, F.lit(0.0)))
        open_ = open_ * F.when(shut, 1 - F.least(-value, F.lit(1.0))).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - 1 / (1 + F.exp(-z))) * open_))


def suppressed(label: Column, profile: Column, risk: Column) -> Column:
    """Whether a claim with that verdict is taken out of an answer of that kind."""
    strict = profile.isin("code", "rag", "qa", "benchmark_qa") | (risk >= 0.75)
    return F.when(label == "contradicted", True).when(label == "unsupported", ~profile.isin("chat", "dialogue")).when(label == "unknown", strict).otherwise(False)


def exact_match(claimed: Column, expected: Column, tolerance: float = 0.01, share: float = 1e-6) -> Column:
    """Numbers within a tolerance; else texts that are equal without regard to case and spaces."""
    a, b = claimed.try_cast("double"), expected.try_cast("double")
    close = (F.abs(a - b) <= tolerance) | (F.abs(a - b) <= share * F.abs(b))
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(a.isNotNull() & b.isNotNull(), close).otherwise(plain(claimed) == plain(expected))


def as_fragments(beliefs: DataFrame, entity: str, confidence: str, body: str, sure: float = 0.85) -> DataFrame:
    """beliefs with source, tokens and pinned: what a selection takes for fragments. A quarter of a body's characters are its tokens; sure ones are pinned."""
    source = F.concat(F.lit("vault://beliefs/"), entity, F.lit("#"), F.substring(F.md5(entity), 1, 8))
    return beliefs.withColumns({"source": source, "tokens": F.greatest(F.lit(1), F.floor(F.length(body) / 4)).cast("long"), "pinned": F.col(confidence) >= sure})
