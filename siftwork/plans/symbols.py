"""Queries on references of code: sources made of line items, names that parts and suppliers define, and a model of characters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.code_refs import WEIGHTS
from ..operators import symbols
from .registry import query, table

#: Sources by part number, with p, s and q for part, supplier and quantity, and what they refer to: (kind, name, line).
SOURCES = (
    (
        "import mod{s}\nfrom pkg{q}.sub import part{p} as other\n\n@deco{s}\ndef ship{p}(x: Kind{q}, *rest) -> Out{s}:\n    y: Tag{p} = x.attr{p}(call{s}(x))[0]\n    return self.__len__\n",
        (("import", "mod{s}", 1), ("import", "pkg{q}", 2), ("import", "part{p}", 2), ("decorator", "deco{s}", 4), ("annotation", "Out{s}", 5), ("annotation", "Kind{q}", 5), ("annotation", "Tag{p}", 6), ("call", "attr{p}", 6), ("attribute", "attr{p}", 6), ("call", "call{s}", 6), ("attribute", "__len__", 7)),
    ),
    ("if part{p}(x) then\n  helper{s} (y); return(z)\n", (("call", "part{p}", 1), ("call", "helper{s}", 2))),
    ("class Big{p}(Base{s}):\n    async def run(self, a=make{q}()):\n        self.x.attr{p}\n", (("call", "make{q}", 2), ("attribute", "attr{p}", 3), ("attribute", "x", 3))),
    ("total = {p} + {q}  # nothing is referred to\n", ()),
)
_COLUMNS = {"{p}": ("l_partkey", "l_partkey::VARCHAR"), "{s}": ("l_suppkey", "l_suppkey::VARCHAR"), "{q}": ("l_quantity", "l_quantity::BIGINT::VARCHAR")}


def filled(text: str):
    parts = [x for x in re.split(r"(\{[psq]\})", text) if x]
    return F.concat(*[F.col(_COLUMNS[x][0]).cast("long").cast("string") if x in _COLUMNS else F.lit(x) for x in parts])


def _sql_filled(text: str) -> str:
    return " || ".join(_COLUMNS[x][1] if x in _COLUMNS else f"'{x}'" for x in re.split(r"(\{[psq]\})", text) if x)


def sources(spark, sf):
    """A source for each kind of item: part, supplier and quantity."""
    source = F.lit(None).cast("string")
    for k, (text, _) in enumerate(SOURCES):
        source = F.when(F.col("l_partkey") % len(SOURCES) == k, filled(text)).otherwise(source)
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity")).distinct()
    return rows.select(F.concat_ws("-", "l_partkey", "l_suppkey", "l_quantity").alias("id"), source.alias("source"))


_REFS = "i AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity::BIGINT AS l_quantity, l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS id FROM lineitem), r AS (" + " UNION ALL ".join(
    f"SELECT id, {_sql_filled(name)} AS name, '{kind}' AS kind, {line} AS line, {WEIGHTS[kind]}::DOUBLE AS weight FROM i WHERE l_partkey % {len(SOURCES)} = {k}" for k, (_, found) in enumerate(SOURCES) for kind, name, line in found
) + ")"


@query("wit24_symbol_refs", f"WITH {_REFS} SELECT id, name, kind, line, weight FROM r")
def wit24(spark, sf):
    """The references of the sources, from their syntax trees or, of those that do not parse, from their calls."""
    return symbols.refs(sources(spark, sf), "id", "source")


def _model_sql(texts: str) -> str:
    return f"""ch AS (SELECT row_number() OVER () AS d, repeat(chr(2), 3) || t || chr(3) AS s FROM ({texts}) WHERE length(t) > 0),
un AS (SELECT d, unnest(regexp_extract_all(s, '(?s).')) AS c, unnest(range(1, length(s) + 1)) AS i FROM ch),
lo AS (SELECT gram, count(*) AS n FROM (SELECT lag(c, 3) OVER w || lag(c, 2) OVER w || lag(c, 1) OVER w || c AS gram FROM un WINDOW w AS (PARTITION BY d ORDER BY i)) WHERE gram IS NOT NULL GROUP BY gram),
co AS (SELECT right(gram, k) AS gram, k AS ord, sum(n)::BIGINT AS n FROM lo, unnest(range(1, 5)) AS u(k) GROUP BY ALL),
mo AS (SELECT gram, ord, n, sum(n) OVER (PARTITION BY ord, left(gram, ord - 1))::BIGINT AS total FROM co)"""


_SURPRISE = f"""nc AS (SELECT name, regexp_extract_all(repeat(chr(2), 3) || name, '(?s).') AS c FROM nm), np AS (SELECT name, i, array_to_string(c[i - 3:i], '') AS gram FROM (SELECT name, c, unnest(range(4, len(c) + 1)) AS i FROM nc)),
nk AS (SELECT name, i, arg_max(ln(n / total) + (4 - ord) * ln({symbols.BACKOFF}), ord) AS p FROM (SELECT name, i, right(gram, k) AS g, k FROM np, unnest(range(1, 5)) AS u(k)) JOIN mo ON mo.gram = g AND mo.ord = k GROUP BY ALL),
su AS (SELECT nm.name, -(coalesce(sum(p), 0) + {symbols.UNKNOWN} * (length(nm.name) - count(p))) / greatest(1, length(nm.name)) AS surprisal FROM nm LEFT JOIN nk ON nm.name = nk.name GROUP BY nm.name)"""


@query("wit25_model", f"WITH {_model_sql('SELECT text AS t FROM documents')} SELECT ord AS \"order\", count(*) AS kinds, sum(n)::BIGINT AS n, sum(total)::BIGINT AS \"of\", bit_xor(hash_) AS grams FROM (SELECT *, ('0x' || substr(md5(gram || '/' || n || '/' || total), 1, 8))::BIGINT AS hash_ FROM mo) GROUP BY ord")
def wit25_model(spark, sf):
    """The model of all documents by length of run: how many runs, their counts, and a digest of them all."""
    mark = F.conv(F.substring(F.md5(F.concat_ws("/", "gram", "n", "of")), 1, 8), 16, 10).cast("long")
    return symbols.train(table(spark, sf, "documents"), "text").groupBy("order").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("of").alias("of"), F.bit_xor(mark).alias("grams"))


@query("wit25_surprisal", rf"WITH {_model_sql('SELECT text AS t FROM documents')}, nm AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS name FROM conversations), {_SURPRISE} SELECT name, round(surprisal, 6)::DOUBLE AS surprisal FROM su")
def wit25(spark, sf):
    """How unusual every word of the conversations is beside all documents, per character."""
    words = table(spark, sf, "conversations").select(F.explode(X.words_of(F.col("text"))).alias("name"))
    return symbols.surprisal(words, "name", symbols.train(table(spark, sf, "documents"), "text")).select("name", F.round("surprisal", 6).alias("surprisal"))


_MANIFEST = "mf AS (SELECT 'part' || p_partkey AS name FROM part WHERE p_size <= 25 UNION SELECT 'attr' || p_partkey FROM part WHERE p_size % 3 = 0 UNION SELECT k || s_suppkey FROM supplier, (VALUES ('mod'), ('deco'), ('call'), ('helper')) AS v(k) WHERE s_suppkey % 2 = 0 UNION SELECT 'x')"


def _verified(spark, sf):
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier").where("s_suppkey % 2 = 0")
    s = s.select("s_suppkey", F.explode(F.array(*[F.lit(k) for k in ("mod", "deco", "call", "helper")])).alias("kind"))
    manifest = p.where("p_size <= 25").select(F.concat(F.lit("part"), "p_partkey").alias("name")).unionByName(p.where("p_size % 3 = 0").select(F.concat(F.lit("attr"), "p_partkey").alias("name")))
    manifest = manifest.unionByName(s.select(F.concat("kind", "s_suppkey").alias("name"))).unionByName(s.limit(1).select(F.lit("x").alias("name")))
    model = symbols.train(p.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t")), "t")
    return symbols.verify(symbols.refs(sources(spark, sf), "id", "source"), manifest, model, "id")


_JUDGED = f"""WITH {_REFS}, {_MANIFEST}, {_model_sql("SELECT p_name || ' ' || p_brand || ' ' || p_type AS t FROM part")}, nm AS (SELECT DISTINCT name FROM r), {_SURPRISE},
j AS (SELECT name, name IN (SELECT name FROM mf) AS there, name IN ({', '.join(f"'{g}'" for g in symbols.GROUND)}) OR regexp_matches(name, '^__[a-zA-Z_]+__$') AS always, surprisal FROM su),
k AS (SELECT name, there OR always AS resolved, surprisal, CASE WHEN always OR length(name) <= 1 THEN 0.0 WHEN NOT there THEN 1.0 ELSE 1 / (1 + exp(-(surprisal - {symbols.MIDDLE}))) END AS p FROM j)"""


@query("wit23_verify_symbols", _JUDGED + " SELECT id, round(1 - exp(sum(weight * ln(1 - least(p, 1 - 1e-12)))), 6)::DOUBLE AS h, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (resolved AND p > 0.5) AS suspicious FROM r JOIN k USING (name) GROUP BY id")
def wit23(spark, sf):
    """The chance of each source that it refers to something that is not there."""
    return _verified(spark, sf)[1].withColumn("h", F.round("h", 6))


@query("wit23_symbol_verdicts", _JUDGED + " SELECT name, kind, count(*) AS n, any_value(resolved) AS resolved, round(any_value(p), 6)::DOUBLE AS p FROM r JOIN k USING (name) GROUP BY name, kind")
def wit23_verdicts(spark, sf):
    v = _verified(spark, sf)[0].groupBy("name", "kind").agg(F.count("*").alias("n"), F.first("resolved").alias("resolved"), F.first("p").alias("p"))
    return v.withColumn("p", F.round("p", 6))
