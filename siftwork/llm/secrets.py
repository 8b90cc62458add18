"""Secret scans (8), native: a trigram index narrows each rule to candidate documents, and regexes verify these.

Everything on the data's path is a DataFrame or SQL function. Python runs on the driver only, to derive each
rule's Boolean trigram query from its regex.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


#: Candidate documents up to which they are broadcast; more are joined by shuffle.
BROADCAST_CANDIDATES = 500_000


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters; others are dropped, but still consumed.
    group: int = 0
    least: int = 0


#: The base kinds, in their order. Runs of one class are matched from their least length at once: this gives
#: the same spans as matching every run and dropping the short ones.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the scan adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
#: Alternatives that a pattern is expanded into, at most; beyond that a part counts as unknown text.
PATHS, CLASS_SIZE = 256, 8
_GAP = None


def _paths(parsed) -> list[list]:
    """The pattern as alternatives, each a list of literal characters and gaps of unknown text."""
    out: list[list] = [[]]
    for op, arg in parsed:
        if op is C.LITERAL:
            more = [[chr(arg).lower()]]
        elif op is C.IN and len(arg) <= CLASS_SIZE and all(o is C.LITERAL for o, _ in arg):
            more = [[chr(x).lower()] for _, x in arg]
        elif op is C.SUBPATTERN:
            more = _paths(arg[3])
        elif op is C.BRANCH:
            more = [p for branch in arg[1] for p in _paths(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1):
            more = [[], *_paths(arg[2])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == arg[1] == 1:
            more = _paths(arg[2])
        elif op is C.AT:
            more = [[]]
        else:
            more = [[_GAP]]
        if len(out) * len(more) > PATHS:
            more = [[_GAP]]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean query of a regex: an OR over sets of lower-case trigrams that must all occur.

    None if some way to match has no mandatory trigram: then the rule has to scan every document.
    """
    clauses = set()
    for path in _paths(P.parse(pattern)):
        found, run = set(), ""
        for c in [*path, _GAP]:
            if c is _GAP:
                found |= {run[k : k + 3] for k in range(len(run) - 2)}
                run = ""
            else:
                run += c
        clauses.add(frozenset(found))
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: rows (trigram, doc_id), letters in lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """Rows (doc_id, rules): the indexed rules whose Boolean query the postings of the document satisfy."""
    rows, trigrams = [], set()
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule.pattern) or []):
            trigrams |= clause
            rows += [f"({_quoted(rule.kind)}, {n}, {_quoted(t)}, {1 << k}L, {(1 << len(clause)) - 1}L)" for k, t in enumerate(sorted(clause))]
    if not rows:
        return None
    wanted = docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS q(kind, clause, trigram, bit, every)")
    met = postings(docs, sorted(trigrams)).join(F.broadcast(wanted), "trigram").groupBy("doc_id", "kind", "clause").agg(F.bit_or("bit").alias("met"), F.first("every").alias("every"))
    return met.where("met = every").groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _running(steps: str) -> tuple[dict[str, Column], Column]:
    """Running sums of the array column: helper columns to add first, then the sums.

    In blocks of 256, so that texts with very many matches cost no square of their number.
    """
    local, base = f"{steps}_local", f"{steps}_base"
    blocks = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 256).cast("int")), lambda c: F.slice(steps, c * 256 + 1, 256))).otherwise(F.array())
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
    bases = F.aggregate(F.col(local), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(x, -1))))
    total = F.flatten(F.transform(F.col(local), lambda x, c: F.transform(F.slice(x, 2, 256), lambda v: v + F.get(F.col(base), c))))
    return {local: sums, base: bases}, total


def _spans(df: DataFrame, rule: Rule, order: int, indexed: bool) -> DataFrame:
    """df with a column named as the rule's kind: an array of (start, kind's place, end, kind)."""
    k, pattern = rule.kind, F.lit(rule.pattern)
    none = F.array().cast("array<string>")
    may = F.array_contains("_rules", k) if indexed else F.lit(True)
    df = df.withColumn(f"{k}_m", F.when(may, F.regexp_extract_all("_body", pattern, F.lit(0))).otherwise(none))
    some = F.size(f"{k}_m") > 0
    kept = F.length if not rule.group else None
    df = df.withColumn(f"{k}_p", F.when(some, F.split("_body", rule.pattern, -1)).otherwise(none))
    if rule.group:
        df = df.withColumn(f"{k}_g", F.when(some, F.regexp_extract_all("_body", pattern, F.lit(rule.group))).otherwise(none))
    df = df.withColumn(f"{k}_s", F.transform(f"{k}_m", lambda m, i: F.length(m) + F.length(F.get(f"{k}_p", i))))
    helpers, total = _running(f"{k}_s")
    for name, value in helpers.items():
        df = df.withColumn(name, value)
    df = df.withColumn(f"{k}_e", total)
    each = F.transform(
        f"{k}_m",
        lambda m, i: F.struct(
            (F.get(f"{k}_e", i) - F.length(m)).alias("start"), F.lit(order).alias("place"), F.get(f"{k}_e", i).alias("end"), F.lit(k).alias("kind"), (F.length(m) if kept else F.length(F.get(f"{k}_g", i))).alias("size")
        ),
    )
    each = F.filter(each, lambda x: x["size"] >= rule.least)
    df = df.withColumn(k, F.transform(each, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return df.drop(*[f"{k}_{x}" for x in ("m", "p", "g", "s", "e", "s_local", "s_base")])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with one array column for each rule's kind: its spans (start, place, end, kind) in code points.

    Matches are leftmost and do not overlap within a kind. Rules with mandatory trigrams are tried on the
    documents whose postings satisfy their query; the others on every document. Null texts count as empty.
    Candidates are found by doc_id: rows that share one, or have none, share their candidates too, which
    changes no result, as each text is verified. An empty table gives an empty result; columns of docs named
    as a kind are replaced.
    """
    docs = docs.drop(*[r.kind for r in rules])
    found = candidates(docs, rules)
    columns = docs.columns
    if found is None:
        df = docs.withColumn("_rules", F.array().cast("array<string>"))
    else:
        found = written(found.select(F.col("doc_id").alias("_candidate"), F.col("rules").alias("_rules")), "candidates")
        few = found.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
        df = docs.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col("_candidate")), "left").withColumn("_rules", F.coalesce("_rules", F.array().cast("array<string>")))
    df = df.withColumn("_body", F.coalesce("text", F.lit("")))
    for place, rule in enumerate(rules):
        df = _spans(df, rule, place, trigram_query(rule.pattern) is not None)
    return df.select(*columns, *[r.kind for r in rules])


def _joined(kinds: list[str]) -> Column:
    spans = F.array_sort(F.concat(*kinds)) if len(kinds) > 1 else F.col(kinds[0])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base, every = [r.kind for r in BASE], [r.kind for r in BASE + MORE]
    found = scan(docs)
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))




def _oracle() -> str:
    """The same by plain regexes over every text: matches and the text between them, whose lengths add up."""
    parts = []
    for n, r in enumerate(BASE + MORE):
        flags, pattern = ("'i'", r.pattern[4:]) if r.pattern.startswith("(?i)") else ("''", r.pattern)
        p = "'" + pattern.replace("'", "''") + "'"
        split = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT r, {n} AS place, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(body, {p}, 0, {flags}) AS m,"
            f" regexp_extract_all(body, {p}, {r.group}, {flags}) AS g, string_split_regex(body, {split}) AS p FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
s AS ({" UNION ALL ".join(parts)}),
e AS (SELECT r, place, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM s WHERE len(m) > 0),
x AS (SELECT r, place, kind, length(g[i]) AS size, least, list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS start, length(m[i]) AS n FROM e),
k AS (SELECT r, place, kind, start::BIGINT AS start, (start + n)::BIGINT AS fin FROM x WHERE size >= least),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, place) FILTER (place < {len(BASE)}), '') AS base,
 string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, place) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


SQL = _oracle()
