"""Context in three levels: a line for every file, the structure around what is relevant, and whole fragments where it matters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import module_of
from ..sources.shared import bucketed, joins_in_place

# --- fixed values: share and bounds of the first level, shares of the second by entropy, depth, relevance by rank, of neighbours, least gain ---
FIRST, FIRST_BOUNDS = 0.05, (50.0, 500.0)
SECOND = ((0.7, 0.20), (0.3, 0.35), (None, 0.25))
DEPTH, PER_RANK, MOST_LOSS, NEIGHBOUR, LEAST = 2, 0.05, 0.8, 0.3, 0.1
SYMBOLS = 6
#: A line of a skeleton with the name that it defines in one of five groups. Loops are over single characters only, which take no stack.
_MORE, _END = r"(?=[^\S\n]*+\S)", r"[^\S\n]*(?=\n|\z)"
NAME = (
    r"(?md)^[^\S\n]*+(?:"
    rf"(?=(?:async )?def {_MORE})(?:async {_MORE})*+(?:def {_MORE})*+(?: *+_[^\n]*+| *+([^(\n]*?)(?: *\([^\n]*+|{_END}))"
    rf"|(?=class {_MORE})(?:class {_MORE})*+ *+([^(:\n]*?)(?: *[(:][^\n]*+|{_END})"
    r"|(?:pub )?fn [^\S\n]*+([^\s(<]*+)[^\n]*+"
    r"|(?:pub )?(?:struct|enum|trait) [^\S\n]*+(\S*?)[{<:]*+(?!\S)[^\n]*+"
    r"|(?=[^\n]*function [^\n]*\S)[^\n]*?(?<!\S)function(?!\S)[^\S\n]++([^\s(]*+)[^\n]*+"
    r"|[^\n]*+)"
)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def one_liner(skeleton: Column) -> Column:
    """The names that a skeleton defines, in one line: functions that are not private, classes, types; of more than six the first five.

    One pass of one pattern leaves of every line its name or nothing.
    """
    names = F.regexp_extract_all(F.regexp_replace(F.coalesce(skeleton, F.lit("")), NAME, "$1$2$3$4$5"), F.lit(r"[^\n]+"), F.lit(0))
    many = lambda n: F.concat(F.array_join(F.slice(n, 1, SYMBOLS - 1), ", "), F.lit(", +"), (F.size(n) - (SYMBOLS - 1)).cast("string"), F.lit(" more"))
    return _with(names, lambda n: F.when(F.size(n) > SYMBOLS, many(n)).otherwise(F.array_join(n, ", ")))


def budgets(total: Column, entropy: Column) -> list[Column]:
    """What the three levels may use (b1, b2, b3): the first a small share, the second more where fragments are plain, the third the rest."""
    low, high = FIRST_BOUNDS
    b1 = F.least(F.greatest(total * FIRST, F.lit(low)), F.lit(high)).cast("long")
    rest = F.greatest(total - b1, F.lit(0))
    ratio = F.when(entropy > SECOND[0][0], SECOND[0][1]).when(entropy < SECOND[1][0], SECOND[1][1]).otherwise(SECOND[2][1])
    b2 = (rest * ratio).cast("long")
    none = (total <= 0) | total.isNull()
    return [F.when(none, 0).otherwise(x).cast("long").alias(n) for n, x in (("b1", b1), ("b2", b2), ("b3", rest - b2))]


def _layers(seeds: DataFrame, edges: DataFrame, group: str, key: str, depth: int) -> list[DataFrame]:
    """Tables (group, key, depth) of what the seeds reach in exactly so many steps, bucketed by group."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = bucketed(edges.select(group, ends.alias("e")).select(group, "e.src", "e.dst").distinct(), "levels-edges", group)
    layers = [bucketed(seeds.select(group, key).distinct().withColumn("depth", F.lit(0)), "levels-layer", group)]
    for d in range(1, depth + 1):
        with joins_in_place(seeds.sparkSession):
            step = both.join(layers[-1].select(group, F.col(key).alias("src")), [group, "src"]).select(group, F.col("dst").alias(key)).distinct()
            layers.append(bucketed(step.withColumn("depth", F.lit(d)), "levels-layer", group))
    return layers


def cluster(seeds: DataFrame, edges: DataFrame, group: str, key: str, depth: int = DEPTH) -> DataFrame:
    """Rows (group, key, depth): what the seeds of every group reach within so many edges (group, src, dst), either way, at the least depth.

    Edges and layers are written, bucketed by group: each is read twice, and their joins shuffle nothing.
    """
    return reduce(DataFrame.unionByName, _layers(seeds, edges, group, key, depth)).groupBy(group, key).agg(F.min("depth").alias("depth"))


def around(fragments: DataFrame, relevant: DataFrame, edges: DataFrame, group: str, key: str, depth: int = DEPTH) -> DataFrame:
    """fragments with depth, as in cluster() of what is relevant, and rank, the least of relevant (group, key, rank); null where there is none.

    A table bucketed by group. Where fragments are such a table too, nothing is shuffled for it.
    """
    layers = [x.select(group, key, F.col("depth").alias(f"_d{d}")) for d, x in enumerate(_layers(relevant, edges, group, key, depth))]
    rows = fragments.join(relevant.groupBy(group, key).agg(F.min("rank").alias("rank")), [group, key], "left")
    rows = reduce(lambda a, b: a.join(b, [group, key], "left"), layers, rows)
    return bucketed(rows.select(*fragments.columns, "rank", F.coalesce(*[f"_d{d}" for d in range(depth + 1)]).alias("depth")), "levels-files", group)


def _joined(pieces: DataFrame, limits: DataFrame | int, group: str, key: str, piece: str, name: str) -> DataFrame:
    """Rows (group, name, name_bytes): pieces of a group joined by newlines, cut to 4 bytes a token of its limit at the end of a line.

    limits is a table (group, limit) or one limit for all. Only pieces that begin within the limit are brought
    together, so a text is as long as its limit and one piece more, however many files a project has; bytes are
    those of the whole, from a sum. All of it is windows and sums by group, behind one shuffle at most.
    """
    rows = pieces.where(F.col(group).isNotNull()).withColumn("limit", F.lit(limits)) if isinstance(limits, int) else pieces.join(limits.select(group, "limit"), group)
    rows = rows.select(group, key, piece, (F.col("limit") * 4).alias("_most"), (F.octet_length(piece) + 1).alias("_size"))
    by = Window.partitionBy(group)
    near = rows.withColumn("_at", F.coalesce(F.sum("_size").over(by.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_size").over(by) - 1)
    part = near.where(F.col("_at") <= F.col("_most")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(key, F.col(piece).alias("_p")))).alias("_l"), F.first("_most").alias("_most"), F.first("_all").alias(f"{name}_bytes"))
    text = F.array_join(F.transform("_l", lambda x: x["_p"]), "\n")
    cut = F.expr("make_valid_utf8(cast(substring(encode(_text, 'UTF-8'), 1, cast(_most as int)) as string))")
    line = F.when(cut.contains("\n"), F.regexp_replace(cut, r"(?s)\n[^\n]*\z", "")).otherwise(F.regexp_replace(cut, "�+$", ""))
    over = F.greatest(F.floor(F.col(f"{name}_bytes") / 4), F.lit(1)) * 4 > F.col("_most")
    return part.withColumn("_text", text).select(group, F.when(over & (F.col(f"{name}_bytes") > F.col("_most")), line).otherwise(F.col("_text")).alias(name), f"{name}_bytes")


def _line(source: str, skeleton: str) -> Column:
    return _with(one_liner(F.col(skeleton)), lambda x: F.when(x == "", F.col(source)).otherwise(F.concat(source, F.lit(" → "), x)))


def level1(fragments: DataFrame, limits: DataFrame | int, group: str, key: str, source: str = "source", skeleton: str = "skeleton") -> DataFrame:
    """Rows (group, level1, level1_bytes): a line for every file of a project, its source and the names it defines."""
    return _joined(fragments.select(group, key, _line(source, skeleton).alias("_line")), limits, group, key, "_line", "level1")


def level2(members: DataFrame, limits: DataFrame | int, group: str, key: str, source: str = "source", skeleton: str = "skeleton") -> DataFrame:
    """Rows (group, level2, level2_bytes): skeletons of the fragments around what is relevant (members), each below its source."""
    pieces = members.where(F.col(skeleton).isNotNull())
    return _joined(pieces.select(group, key, F.concat(F.lit("## "), source, F.lit("\n"), skeleton, F.lit("\n")).alias("_piece")), limits, group, key, "_piece", "level2")


def level3(candidates: DataFrame, room: DataFrame, group: str, order: str, key: str, base: str, source: str, tokens: str) -> DataFrame:
    """Rows (group, key, place) taken in order: where the gain, base relevance over one more than what its module has already, is over 0.1, and the tokens fit.

    Each task streams its groups in order and keeps of the one at hand what is used and a count for each module;
    no group is held.
    """
    kinds = dict(candidates.dtypes)
    rows = candidates.select(group, order, key, base, module_of(F.col(source)).alias("_module"), F.col(tokens).alias("_t")).join(room.select(group, "room"), group)
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, group).sortWithinPartitions(group, order, key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, counts, place = object(), 0, {}, 0
        for pdf in frames:
            out = []
            for g, k, b, m, t, r in zip(pdf[group], pdf[key], pdf[base], pdf["_module"], pdf["_t"], pdf["room"], strict=True):
                if g != now:
                    now, used, counts, place = g, 0, {}, 0
                if b / (1.0 + counts.get(m, 0)) > LEAST and used + t <= r:
                    out.append((g, k, place))
                    counts[m], used, place = counts.get(m, 0) + 1, used + t, place + 1
            yield pd.DataFrame(out, columns=[group, key, "place"])

    return rows.mapInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, place int")


def compress(fragments: DataFrame, relevant: DataFrame, edges: DataFrame, total: int, group: str, key: str, source: str = "source", skeleton: str = "skeleton", tokens: str = "tokens", entropy: str = "entropy") -> tuple[DataFrame, DataFrame]:
    """(packs, chosen) for every project at once, under a budget of total tokens each.

    packs has (group, level1, level2, used1, used2, used3, files, members, whole); chosen has (group, key, place)
    of the fragments shown in full. relevant has (group, key, rank), rank from 0. What the first two levels leave
    goes to the third: relevant fragments by rank, then their neighbours by depth and key. A project without
    relevant fragments has a first level only. Null skeletons give lines of sources alone.
    """
    files = around(fragments.select(group, key, source, skeleton, tokens, entropy), relevant, edges, group, key)
    inside = F.col("depth").isNotNull()
    # a skeleton's tokens are its own bytes over 4, heads and newlines aside
    sizes = F.sum(F.when(inside & F.col(skeleton).isNotNull(), F.greatest(F.floor(F.octet_length(skeleton) / 4), F.lit(1))))
    sums = files.groupBy(group).agg(F.count("*").alias("files"), F.avg(entropy).alias("_e"), F.count("depth").alias("members"), (F.sum(F.octet_length(_line(source, skeleton)) + 1) - 1).alias("_bytes"), sizes.alias("_skeletons"))
    sums = sums.select(group, "files", "members", *budgets(F.lit(total), F.col("_e")), "_bytes", "_skeletons")
    sums = sums.withColumn("used1", F.least(F.greatest(F.floor(F.col("_bytes") / 4), F.lit(1)), F.col("b1"))).withColumn("used2", F.least(F.coalesce("_skeletons", F.lit(0)), F.col("b2")))
    sums = bucketed(sums.withColumn("room", F.col("b3") + F.col("b1") - F.col("used1") + F.col("b2") - F.col("used2")).drop("_bytes", "_skeletons"), "levels-sums", group)
    base = F.when(F.col("rank").isNotNull(), 1.0 - F.least(F.col("rank") * PER_RANK, F.lit(MOST_LOSS))).otherwise(NEIGHBOUR)
    order = F.struct(F.col("rank").isNull().alias("a"), F.coalesce("rank", "depth").alias("b"), F.col(key).alias("c"))
    chosen = bucketed(level3(files.where(inside).withColumn("base", base).withColumn("_order", order), sums, group, "_order", key, "base", source, tokens), "levels-chosen", group, placed=True)
    used = chosen.join(files.where(inside).select(group, key, tokens), [group, key]).groupBy(group).agg(F.sum(tokens).alias("used3"), F.count("*").alias("whole"))
    used = bucketed(used, "levels-used", group)
    one = level1(files, sums.select(group, F.col("b1").alias("limit")), group, key, source, skeleton).drop("level1_bytes")
    two = level2(files.where(inside), sums.select(group, F.col("b2").alias("limit")), group, key, source, skeleton).drop("level2_bytes")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = sums.join(one, group).join(two, group, "left").join(used, group, "left")
    return out.select(group, "level1", F.coalesce("level2", F.lit("")).alias("level2"), "used1", "used2", zero("used3"), "files", "members", zero("whole")), chosen


def formatted(packs: DataFrame, chosen: DataFrame, fragments: DataFrame, group: str, key: str, source: str, text: str, tokens: str) -> DataFrame:
    """Rows (group, context): the three levels as one text, each part under its head, parts that are empty left out.

    What a project brings together is within its budget.
    """
    shown = chosen.join(fragments.select(group, key, source, text, tokens), [group, key])
    one = F.concat(F.lit("### "), source, F.lit(" ("), F.col(tokens).cast("string"), F.lit(" tokens)\n```\n"), F.rtrim(text), F.lit("\n```\n"))
    bodies = bucketed(shown.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", one.alias("_b")))).alias("_bodies")), "levels-bodies", group)
    rows = packs.join(bodies, group, "left")
    head = lambda there, *parts: F.when(there, F.concat(*parts))
    count = lambda c: F.col(c).cast("string")
    parts = [
        F.lit("--- Relevant Code Context ---\n"),
        head(F.col("level1") != "", F.lit("## Codebase Overview ("), count("files"), F.lit(" files)\n```\n"), F.rtrim("level1"), F.lit("\n```\n")),
        head(F.col("level2") != "", F.lit("## Related Code Structure ("), count("members"), F.lit(" connected files)\n"), F.regexp_replace("level2", r"\s+$", ""), F.lit("\n")),
        head(F.col("_bodies").isNotNull(), F.lit("## Full Code ("), count("whole"), F.lit(" fragments)\n"), F.array_join(F.transform("_bodies", lambda x: x["_b"]), "\n")),
        F.lit("--- End Context ---"),
    ]
    return rows.select(group, F.array_join(F.array_compact(F.array(*parts)), "\n").alias("context"))
