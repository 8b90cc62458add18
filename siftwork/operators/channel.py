"""The order in which chosen fragments are shown, and what fills the room that is left: for every question of a table at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import criticality
from ..sources.shared import written

# --- fixed values: what criticality multiplies importance by; attention at the ends, in the middle, and how far the ends reach ---
BOOSTS = (("safety", 3.0), ("critical", 2.0), ("important", 1.5))
ENDS, MIDDLE, REACH = 0.4, 0.2, 0.15
DEFINES = 1.5


def levels(nodes: DataFrame, edges: DataFrame, group: str, key: str) -> DataFrame:
    """Rows (group, key, level): topological levels of every group's graph of edges (group, src, dst), all groups at once.

    Each round takes the nodes without edges into them off, counts their edges down where they lead, and gives
    them the round's number: the length of the longest way to them. Nodes on a cycle, and behind one, are never
    taken off and have level 0. Rounds are as many as the longest way; each is one join and one written table.
    Edges to themselves, from or to other nodes, repeated ones, and groups that are null don't count.
    """
    ids = nodes.select(group, key).distinct()
    end = lambda c: ids.select(group, F.col(key).alias(c))
    links = edges.select(group, "src", "dst").where("src <> dst").distinct().join(end("src"), [group, "src"], "left_semi").join(end("dst"), [group, "dst"], "left_semi")
    links = written(links, "channel-links")
    into = links.groupBy(group, F.col("dst").alias(key)).agg(F.count("*").alias("n"))
    state = written(ids.join(into, [group, key], "left").select(group, key, F.coalesce("n", F.lit(0)).alias("left"), F.lit(None).cast("int").alias("level")), "channel-levels")
    heads, level = (F.col("left") == 0) & F.col("level").isNull(), 0
    while not state.where(heads).isEmpty():
        gone = links.join(state.where(heads).select(group, F.col(key).alias("src")), [group, "src"]).groupBy(group, F.col("dst").alias(key)).agg(F.count("*").alias("gone"))
        after = state.join(gone, [group, key], "left").select(group, key, (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left"), F.when(heads, level).otherwise(F.col("level")).alias("level"))
        state, level = written(after, "channel-levels"), level + 1
    return state.select(group, key, F.coalesce("level", F.lit(0)).alias("level"))


def importance(relevance: Column, path: Column) -> Column:
    """Relevance, raised for files that matter whatever is asked."""
    kind, factor = criticality(path), F.lit(1.0)
    for name, boost in BOOSTS:
        factor = F.when(kind == name, boost).otherwise(factor)
    return relevance * factor


def attention(place: Column, n: Column) -> Column:
    """The weight of a place (from 0) in a context of n: high at both ends, low in the middle."""
    reach = F.greatest(F.lit(REACH) * n, F.lit(1.0))
    return F.when(n <= 1, 1.0).otherwise(ENDS * F.exp(-place / reach) + ENDS * F.exp(-(n - 1 - place) / reach) + MIDDLE)


def interleave(levelled: DataFrame, group: str, key: str, importance: str) -> DataFrame:
    """levelled with place (from 0): definitions before what refers to them, important ones first; the last level turned round, so that its most important one is at the very end.

    Ties go to the smaller key. A group is what was chosen for a question, which its budget bounds.
    """
    w = Window.partitionBy(group)
    last = (F.max("level").over(w) == F.col("level")) & (F.max("level").over(w) > 0)
    sign = F.when(F.col("_leaf"), 1).otherwise(-1)
    order = ["_leaf", "level", sign * F.col(importance), -sign * F.col(key)]
    return levelled.withColumn("_leaf", last).withColumn("place", (F.row_number().over(w.orderBy(*order)) - 1)).drop("_leaf")


def bookend(placed: DataFrame, group: str, relevance: str, place: str = "place") -> DataFrame:
    """placed with slot: in each level of over two fragments the one of relevance rank r stands where attention is r-th highest.

    Levels take up stretches one after another, so no fragment passes what it refers to. Ranks meet slots by
    sorting both: no join, two windows over a level.
    """
    own, whole = Window.partitionBy(group, "level"), Window.partitionBy(group)
    rows = placed.withColumn("_n", F.count("*").over(whole)).withColumn("_size", F.count("*").over(own))
    start = F.row_number().over(whole.orderBy("level", place)) - 1  # the stretch's places, by level
    rows = rows.withColumn("_spot", start).withColumn("_seen", F.round(attention(F.col("_spot"), F.col("_n")), 12))
    rows = rows.withColumn("_rank", F.row_number().over(own.orderBy(F.desc(relevance), F.asc(place)))).withColumn("_of", F.row_number().over(own.orderBy(F.desc("_seen"), F.asc("_spot"))))
    slots = F.array_sort(F.collect_list(F.struct("_of", "_spot")).over(own))  # as many as the level has fragments
    slot = F.when(F.col("_size") <= 2, F.col("_spot")).otherwise(F.element_at(slots, F.col("_rank"))["_spot"])
    return rows.withColumn("slot", slot).drop("_n", "_size", "_spot", "_seen", "_rank", "_of")


def trigrams(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Rows (group, key, gram, n): the runs of three bytes of each text with how often they occur."""
    data = F.encode(F.col(text), "UTF-8")
    runs = F.when(F.octet_length(data) >= 3, F.transform(F.sequence(F.lit(1), F.octet_length(data) - 2), lambda i: F.substring(data, i, 3)))
    return df.select(group, key, F.explode(runs).alias("gram")).groupBy(group, key, "gram").agg(F.count("*").alias("n"))


def marginal_gain(candidates: DataFrame, chosen: DataFrame, group: str, key: str, text: str, entropy: str, defines: str) -> DataFrame:
    """candidates with gain: entropy, times the share of their byte trigrams that no chosen fragment of the group has, times 1.5 where they define a symbol.

    What is covered is a set of trigrams of each group (at most 2^24), joined to the candidates' own. Texts of
    under three bytes are all new.
    """
    covered = trigrams(chosen, group, key, text).select(group, "gram").distinct().withColumn("_old", F.lit(True))
    share = trigrams(candidates, group, key, text).join(covered, [group, "gram"], "left").groupBy(group, key).agg(F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_old"), F.col("n"))), F.lit(0)).alias("_met"))
    novelty = 1.0 - F.coalesce(F.col("_met") / F.col("_all"), F.lit(0.0))
    return candidates.join(share, [group, key], "left").withColumn("gain", F.col(entropy) * novelty * F.when(F.col(defines), DEFINES).otherwise(1.0)).drop("_all", "_met")


def fill(rows: DataFrame, room: DataFrame, group: str, key: str, order: list, tokens: str = "tokens", chunk: int = 1000) -> DataFrame:
    """Rows (group, key, tokens, place) taken by first fit: in order, each that fits what is left of its group's room (group, room).

    No array or task holds a group. Each round takes, for all groups at once, the rows of an order up to the
    first that does not fit; that one never will, and rows that are larger than what is left go with it. Only
    the first chunk rows of a group are looked at in a round, which tasks cut down before they are shuffled.
    """
    w = Window.partitionBy(group).orderBy(*order)
    open_ = written(rows.join(room.select(group, F.col("room").cast("long").alias("_left")), group).where((F.col(tokens) > 0) & (F.col(tokens) <= F.col("_left"))), "channel-open")
    taken: list[DataFrame] = []
    while True:
        part = open_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= chunk)
        part = part.withColumn("_sum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= F.col("_left"))
        got = written(part.select(group, key, tokens, "_r", F.lit(len(taken)).alias("_round")), "channel-taken")
        if got.isEmpty():
            break
        taken.append(got)
        used = got.groupBy(group).agg(F.sum(tokens).alias("_used"))
        rest = open_.join(got.select(group, key), [group, key], "left_anti").join(used, group, "left")
        rest = rest.withColumn("_left", F.col("_left") - F.coalesce("_used", F.lit(0))).drop("_used").where(F.col(tokens) <= F.col("_left"))
        open_ = written(rest, "channel-open")
    every = reduce(DataFrame.unionByName, taken, got)
    return every.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_round", "_r"))).select(group, key, tokens, "place")


def trailing_pass(fragments: DataFrame, chosen: DataFrame, room: DataFrame, group: str, key: str, text: str = "text", tokens: str = "tokens", entropy: str = "entropy", defines: str = "defines") -> DataFrame:
    """Rows (group, key, tokens, place): what else is shown in the room that a selection left, by gain for each token.

    Gains are those beside what was chosen, computed once. Ties (to twelve places) go to the smaller key; a
    group without room gets nothing.
    """
    some = room.where("room > 0")
    picked = fragments.join(chosen.select(group, key), [group, key], "left_semi")
    rest = fragments.join(chosen.select(group, key), [group, key], "left_anti").join(some.select(group, "room"), group).where((F.col(tokens) > 0) & (F.col(tokens) <= F.col("room"))).drop("room")
    scored = marginal_gain(rest, picked, group, key, text, entropy, defines).withColumn("density", F.round(F.col("gain") / F.col(tokens), 12))
    return fill(scored.select(group, key, tokens, "density"), some, group, key, [F.desc("density"), F.asc(key)], tokens)
