"""Queries on context in three levels: every order is a project, its items, numbered, are the files, with skeletons made of their columns."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import levels
from ..sources.shared import bucketed
from .registry import query, table

BUDGET = 1200
#: Skeletons laid over line items by part number, with p, s and q for part, supplier and quantity; null has none.
SKELETONS = (
    "class Part{p}(Base):\n    def ship_{s}(self):\n    def _hidden(self):\n    async def load_{q}(self):\n    x = 1", "pub struct Line{p} {\npub fn cost_{s}<T>(x: T)\n  fn inner_{q}(a)\n", "export function render_{p}(x)\nfunction  helper_{s} (y)\nconst f = 2",
    None, "enum State{p}\npub trait Ship{s}:\npub enum Größe{q}<", "\n".join("def f%d_{p}(a, b):" % k for k in range(8)), "",
)


def _marks(text: str) -> list[str]:
    """A text cut at its marks: pieces and marks in turn."""
    import re

    return re.split(r"(\{[psq]\})", text)


def files(spark, sf):
    column = {"{p}": F.col("l_partkey"), "{s}": F.col("l_suppkey"), "{q}": F.col("l_quantity").cast("long")}
    skeleton = F.lit(None).cast("string")
    for k, text in enumerate(SKELETONS):
        if text is not None:
            skeleton = F.when(F.col("l_partkey") % len(SKELETONS) == k, F.concat(*[column[x].cast("string") if x in column else F.lit(x) for x in _marks(text)])).otherwise(skeleton)
    source = F.concat(F.lit("file:src/m"), F.col("l_suppkey") % 3, F.lit("/f"), F.col("l_partkey"), F.lit("_"), F.col("l_linenumber"), F.lit(".py"))
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf, "lineitem").select("l_orderkey", number.alias("file"), source.alias("source"), skeleton.alias("skeleton"), (F.col("l_quantity") * 10).cast("long").alias("tokens"), (F.col("l_discount") * 10).alias("entropy"), "l_extendedprice", "l_partkey", "l_suppkey")


def relevant(f):
    """An order's two dearest items."""
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "file")
    return f.withColumn("rank", F.row_number().over(w) - 1).where("rank < 2").select("l_orderkey", "file", "rank")


def links(f):
    """An item uses the next one where its supplier's number is even, and the first one where its part's is divisible by five."""
    ends = F.array_compact(F.array(F.when(F.col("l_suppkey") % 2 == 0, F.col("file") + 1), F.when(F.col("l_partkey") % 5 == 0, F.lit(1))))
    return f.select("l_orderkey", F.col("file").alias("src"), F.explode(ends).alias("dst"))


def _sql_text(text: str) -> str:
    names = {"{p}": "l_partkey::VARCHAR", "{s}": "l_suppkey::VARCHAR", "{q}": "l_quantity::BIGINT::VARCHAR"}
    quoted = lambda x: " || chr(10) || ".join("'" + y + "'" for y in x.split("\n"))
    return " || ".join(names.get(x, quoted(x)) for x in _marks(text))


_FILES = f"""f AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS file, 'file:src/m' || (l_suppkey % 3) || '/f' || l_partkey || '_' || l_linenumber || '.py' AS source,
 CASE l_partkey % {len(SKELETONS)} {' '.join(f'WHEN {k} THEN {_sql_text(x)}' for k, x in enumerate(SKELETONS) if x is not None)} END AS skeleton, l_extendedprice, l_partkey, l_suppkey FROM lineitem)"""
_NAMES = r"""n AS (SELECT *, list_filter(list_transform(list_transform(string_split(coalesce(skeleton, ''), chr(10)), lambda x: trim(x)), lambda x:
 CASE WHEN starts_with(x, 'def ') OR starts_with(x, 'async def ') THEN regexp_replace(regexp_extract(x, '^(?:async )*(?:def )*([^(]*)', 1), '^_.*', '')
 WHEN starts_with(x, 'class ') THEN trim(regexp_extract(x, '^(?:class )*([^(:]*)', 1))
 WHEN starts_with(x, 'fn ') OR starts_with(x, 'pub fn ') THEN regexp_extract(x, '^(?:pub\s+)?\S+\s+([^\s(<]*)', 1)
 WHEN regexp_matches(x, '^(pub )?(struct|enum|trait) ') THEN regexp_replace(regexp_extract(x, '^(?:pub\s+)?\S+\s+(\S+)', 1), '[{<:]+$', '')
 WHEN contains(x, 'function ') THEN regexp_extract(x, '(?:^|\s)function\s+([^\s(]+)', 1) ELSE '' END), lambda x: x <> '') AS names FROM f),
o AS (SELECT *, CASE WHEN len(names) > 6 THEN array_to_string(names[1:5], ', ') || ', +' || (len(names) - 5) || ' more' ELSE array_to_string(names, ', ') END AS line FROM n)"""


@query("str47_one_liner", f"WITH {_FILES}, {_NAMES} SELECT l_orderkey, file, line FROM o")
def str47(spark, sf):
    return files(spark, sf).select("l_orderkey", "file", levels.one_liner(F.col("skeleton")).alias("line"))




@query("sel13_level1", f"""WITH {_FILES}, {_NAMES}, l AS (SELECT *, CASE WHEN line = '' THEN source ELSE source || ' → ' || line END AS l FROM o),
a AS (SELECT *, coalesce(sum(strlen(l) + 1) OVER (PARTITION BY l_orderkey ORDER BY file), 0) AS ends, sum(strlen(l) + 1) OVER (PARTITION BY l_orderkey) - 1 AS bytes FROM l)
SELECT l_orderkey, string_agg(l, chr(10) ORDER BY file) AS level1, any_value(bytes)::BIGINT AS level1_bytes FROM a WHERE bytes < 204 OR ends <= 200 GROUP BY l_orderkey""")
def sel13(spark, sf):
    """A line for every item, cut to fifty tokens an order. (No line alone is longer.)"""
    f = files(spark, sf)
    return levels.level1(f, 50, "l_orderkey", "file")


_CLUSTER = """k AS (SELECT l_orderkey, file FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, file) AS r FROM f) WHERE r <= 2),
e AS (SELECT l_orderkey, file AS src, file + 1 AS dst FROM f WHERE l_suppkey % 2 = 0 UNION SELECT l_orderkey, file, 1 FROM f WHERE l_partkey % 5 = 0),
b AS (SELECT * FROM e UNION SELECT l_orderkey, dst, src FROM e), c1 AS (SELECT DISTINCT b.l_orderkey, b.dst AS file FROM b JOIN k ON b.l_orderkey = k.l_orderkey AND b.src = k.file),
c2 AS (SELECT DISTINCT b.l_orderkey, b.dst AS file FROM b JOIN c1 ON b.l_orderkey = c1.l_orderkey AND b.src = c1.file), c AS (SELECT * FROM k UNION SELECT * FROM c1 UNION SELECT * FROM c2)"""


@query("sel14_level2", f"WITH {_FILES}, {_CLUSTER} SELECT l_orderkey, string_agg('## ' || source || chr(10) || skeleton || chr(10), chr(10) ORDER BY file) AS level2 FROM f SEMI JOIN c ON f.l_orderkey = c.l_orderkey AND f.file = c.file WHERE skeleton IS NOT NULL GROUP BY l_orderkey")
def sel14(spark, sf):
    """The skeletons around an order's two dearest items, whole."""
    f = bucketed(files(spark, sf), "order-files", "l_orderkey")
    near = levels.around(f.select("l_orderkey", "file", "source", "skeleton"), relevant(f), links(f), "l_orderkey", "file")
    return levels.level2(near.where("depth is not null"), 100_000, "l_orderkey", "file").select("l_orderkey", "level2")


def _compressed(spark, sf):
    f = bucketed(files(spark, sf), "order-files", "l_orderkey")
    return f, *levels.compress(f, relevant(f), links(f), BUDGET, "l_orderkey", "file")


@query("sel12_level3")
def sel12(spark, sf):
    """The items shown in full, in order; held against a plain version in the tests."""
    return _compressed(spark, sf)[2]


@query("sel26_hierarchical")
def sel26(spark, sf):
    """What the three levels of every order use and cover; held against a plain version in the tests."""
    return _compressed(spark, sf)[1].select("l_orderkey", F.md5("level1").alias("level1"), F.md5("level2").alias("level2"), "used1", "used2", "used3", "files", "members", "whole")


@query("conv35_hierarchical_context")
def conv35(spark, sf):
    """The context of every order as one text; held against a plain version in the tests."""
    f, packs, chosen = _compressed(spark, sf)
    text = levels.formatted(packs, chosen, f.withColumn("body", F.concat_ws("\n", "source", "skeleton")), "l_orderkey", "file", "source", "body", "tokens")
    return text.select("l_orderkey", F.md5("context").alias("context"), F.length("context").alias("size"))
