"""Queries on security findings, guards and kinds of content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compress
from ..functions import routing as R
from ..functions.constants import CONTENT_SIGNS
from ..functions.security_values import SAST_RULES, TAINT_SOURCES
from ..operators import sast
from .registry import query, table
from .samples import CODE, code, pick, quoted, sql_any, sql_code, sql_pick

_PATHS = tuple(p for p, _ in CODE)
_RULES = "rl(rule, languages, taint) AS (VALUES " + ", ".join(f"('{r[0]}', [{', '.join(quoted(x) for x in r[7])}]::VARCHAR[], {str(r[8]).lower()})" for r in SAST_RULES) + ")"
_LANG = "CASE " + " ".join(f"WHEN {sql_any('ends_with', 'lower(path)', ends) if ends else chr(115) + 'tarts_with(regexp_extract(lower(path), ' + quoted('[^/]*$') + '), ' + quoted(name) + ')'} THEN '{name}'" for name, ends in sast.LANGUAGES) + " END"


def sources(spark, sf):
    return code(table(spark, sf, "documents"))


@query("flt12_detect_lang", f"WITH d AS (SELECT doc_id, {sql_pick(_PATHS, 'doc_id')} AS path FROM documents) SELECT doc_id, {_LANG} AS language FROM d")
def flt12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sast.language(pick(_PATHS, F.col("doc_id"))).alias("language"))


@query("flt13_is_non_code", f"WITH d AS (SELECT doc_id, {sql_pick(_PATHS, 'doc_id')} AS path FROM documents) SELECT doc_id, {sql_any('ends_with', 'lower(path)', sast.NO_CODE)} AS no_code FROM d")
def flt13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sast.no_code(pick(_PATHS, F.col("doc_id"))).alias("no_code"))


_SHARES = " OR ".join(f"(language = '{name}' AND len(list_intersect(languages, [{', '.join(quoted(x) for x in more)}])) > 0)" for name, more in sast.ALSO.items())


@query("flt11_rule_applies", f"WITH {_RULES}, d AS (SELECT doc_id, {sql_pick(_PATHS, 'doc_id')} AS path FROM documents), l AS (SELECT DISTINCT path, {_LANG} AS language FROM d) SELECT path, count(*) AS rules FROM l, rl WHERE len(languages) = 0 OR coalesce(list_contains(languages, language), false) OR coalesce({_SHARES}, false) GROUP BY path")
def flt11(spark, sf):
    """How many rules are for each path: the rules, a table of fixed size, are broadcast."""
    p = table(spark, sf, "documents").select(pick(_PATHS, F.col("doc_id")).alias("path")).distinct().withColumn("language", sast.language(F.col("path")))
    hit = sast.rule_applies(F.col("languages"), F.col("language"))
    return p.join(F.broadcast(sast.rule_table(spark)), hit).groupBy("path").agg(F.count("*").alias("rules"))


_LOW_SOURCES = sql_any("contains", "lower(line)", tuple(dict.fromkeys(TAINT_SOURCES)))


@query("flt14_taint_sources", f"WITH {sql_code()}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code) SELECT doc_id, n::INT AS n FROM l WHERE {_LOW_SOURCES}")
def flt14(spark, sf):
    """The lines of each source that bring in what users control."""
    lines = sources(spark, sf).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    return lines.where(R.has_any(F.lower("line"), tuple(dict.fromkeys(TAINT_SOURCES)))).select("doc_id", (F.col("n") + 1).alias("n"))


@query("flt17_confidence_for_context", f"""WITH {sql_code()}, l AS (SELECT doc_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code),
s AS (SELECT doc_id, n, CASE WHEN {sql_any('contains', 'lower(path)', sast.TEST_PARTS)} THEN 0.4 ELSE 1.0 END * CASE WHEN {sql_any('contains', 'lower(line)', sast.QUIET_PARTS)} THEN 0.1 ELSE 1.0 END * CASE WHEN starts_with(ltrim(line), '#') OR starts_with(ltrim(line), '//') THEN 0.1 ELSE 1.0 END AS c FROM l)
SELECT doc_id, n::INT AS n, round(greatest(0.05, c), 6)::DOUBLE AS plain, round(greatest(0.05, least(1.0, c * 1.2)), 6)::DOUBLE AS tainted FROM s""")
def flt17(spark, sf):
    lines = sources(spark, sf).select("doc_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    sure = lambda t: F.round(sast.line_confidence(F.col("path"), F.col("line"), F.lit(t)), 6)
    return lines.select("doc_id", (F.col("n") + 1).alias("n"), sure(False).alias("plain"), sure(True).alias("tainted"))


@query("flt10_scan_content")
def flt10(spark, sf):
    """The findings of every source; held against every rule on every line in the tests."""
    return sast.scan(sources(spark, sf)).select("doc_id", "line", "rule", "cwe", "severity", "category", F.round("confidence", 6).alias("confidence"), "tainted", "content")


@query("flt18_file_risk")
def flt18(spark, sf):
    return sast.risk(sast.scan(sources(spark, sf)))


@query("agg13_security_report")
def agg13(spark, sf):
    return sast.report(sast.scan(sources(spark, sf)))


_GUARD = r"(password|secret|token|api_?key)\s*[:=]"


@query("flt19_fragment_guard", f"""WITH {sql_code()} SELECT doc_id, regexp_matches(content, {quoted(R.V.QUESTION_SECRETS)}, 'i') AS secret, regexp_matches(content, 'unsafe\\s*\\{{') AS unsafe, len(regexp_extract_all(content, 'TODO|FIXME')) >= 3 AS todo, len(regexp_extract_all(content, 'console\\.log|print\\(')) >= 5 AS noisy FROM code""")
def flt19(spark, sf):
    t = F.col("content")
    many = lambda p, n: F.regexp_count(t, F.lit(p)) >= n
    return sources(spark, sf).select("doc_id", t.rlike(R.folded(R.V.QUESTION_SECRETS)).alias("secret"), t.rlike(r"unsafe\s*\{").alias("unsafe"), many("TODO|FIXME", 3).alias("todo"), many(r"console\.log|print\(", 5).alias("noisy"))


_KINDS = {"json": r"^\s*[{\[]", "xml": r"^\s*<"}


def _sign(kind: str, pattern: str | None, width: int | None) -> str:
    count = lambda c: f"(length(t) - length(replace(t, {c}, '')))"
    if kind == "csv":
        return f"{count(quoted(','))} > 10 AND {count('chr(10)')} > 3 AND {count(quoted(','))} > 2 * {count('chr(10)')}"
    if kind == "table":
        return f"{count(quoted('|'))} > 6 AND {count('chr(10)')} > 2"
    x = "t" if width is None else f"left(t, {width})"
    if kind in _KINDS:
        return f"regexp_matches(t, {quoted(_KINDS[kind])})" + (" AND contains(left(t, 200), '>')" if kind == "xml" else "")
    return f"regexp_matches({x}, {quoted(pattern)})"


_TYPE = "CASE WHEN length(t) < 20 THEN 'prose' " + " ".join(f"WHEN {_sign(*s)} THEN '{s[0]}'" for s in CONTENT_SIGNS) + " ELSE 'prose' END"


@query("flt9_detect_content_type", f"""WITH {sql_code()}, a AS (SELECT 'page' AS origin, page_id AS id, html AS t FROM pages UNION ALL SELECT 'event', event_id, props FROM events UNION ALL SELECT 'source', doc_id, content FROM code UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT origin, id, {_TYPE} AS kind FROM a WHERE t IS NOT NULL""")
def flt9(spark, sf):
    one = lambda name, key, text: table(spark, sf, name).select(F.lit(name[:-1]).alias("origin"), F.col(key).alias("id"), F.col(text).alias("t"))
    every = one("pages", "page_id", "html").unionAll(one("events", "event_id", "props")).unionAll(one("documents", "doc_id", "text"))
    every = every.unionAll(sources(spark, sf).select(F.lit("source"), "doc_id", "content")).where("t is not null")
    return every.select("origin", "id", compress.content_type(F.col("t")).alias("kind"))
