"""Security findings in sources: rules on lines, with what users control followed through assignments.

A text is read once by an automaton over all parts of lines that any rule or source of taint asks for. Only lines
that have one are looked at again, with the few rules that ask for it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.routing import first_of
from ..functions.security_values import SAST_RULES, TAINT_PROPAGATORS, TAINT_SOURCES
from ..functions.text import any_of, basename_of, has_any

# --- fixed values: languages by the end of a path, ends of files that are no code, weights of severities, languages that share rules ---
LANGUAGES = (
    ("py", (".py", ".pyw")), ("rs", (".rs",)), ("js", (".js", ".jsx", ".mjs", ".cjs")), ("ts", (".ts", ".tsx", ".mts", ".cts")), ("go", (".go",)), ("java", (".java", ".kt")), ("cs", (".cs", ".csx")), ("swift", (".swift",)),
    ("c", (".c", ".h")), ("cpp", (".cpp", ".cc", ".hpp", ".hxx")), ("php", (".php",)), ("rb", (".rb",)), ("sh", (".sh", ".bash", ".zsh")), ("dockerfile", ()), ("tf", (".tf", ".hcl")), ("vue", (".vue",)), ("svelte", (".svelte",)),
    ("html", (".html", ".htm")), ("css", (".css", ".scss", ".less")),
)
NO_CODE = (".md", ".txt", ".rst", ".svg", ".xml", ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".csv")
WEIGHTS = (("info", 0.5), ("low", 1.5), ("medium", 3.0), ("high", 6.5), ("critical", 9.5))
ALSO = {"cs": ("java",), "c": ("cpp",), "vue": ("js", "ts"), "svelte": ("js", "ts")}
TEST_PARTS, QUIET_PARTS = ("test_", "_test.", "spec.", "mock"), ("nosec", "noqa", "sast-ignore")
SECRETS = 798

FINDING = "array<struct<line:int,rule:string,cwe:int,severity:string,category:string,confidence:double,tainted:boolean,content:string>>"
_ASSIGNED = re.compile(r"(?<![=!<>])=(?!=)")
_SEVERITY = {name: k for k, (name, _) in enumerate(WEIGHTS)}


def language(path: Column) -> Column:
    """The language of a path, null if none is known."""
    low = F.lower(path)
    cases = [(name, any_of(low.endswith(e) for e in ends) if ends else basename_of(low).startswith(name)) for name, ends in LANGUAGES]
    return first_of(cases, None)


def no_code(path: Column) -> Column:
    return any_of(F.lower(path).endswith(e) for e in NO_CODE)


def rule_table(spark) -> DataFrame:
    """The rules, a table of fixed size; without languages a rule is for all."""
    rows = [(name, cwe, severity, category, part, list(languages), taint) for name, cwe, severity, category, part, _, _, languages, taint in SAST_RULES]
    return spark.createDataFrame(rows, "rule string, cwe int, severity string, category string, part string, languages array<string>, taint boolean")


def rule_applies(languages: Column, language: Column) -> Column:
    """Whether a rule's languages have one, or one that shares its rules."""
    shares = [F.array_contains(languages, language)] + [(language == name) & F.arrays_overlap(languages, F.array(*[F.lit(x) for x in more])) for name, more in ALSO.items()]
    return (F.size(languages) == 0) | F.coalesce(any_of(shares), F.lit(False))


def line_confidence(path: Column, line: Column, taint: Column) -> Column:
    """How sure a finding is: less in tests, beside a mark that quiets it and in comments, more with taint."""
    low, bare = F.lower(line), F.ltrim(line)
    sure = F.when(has_any(F.lower(path), TEST_PARTS), 0.4).otherwise(1.0) * F.when(has_any(low, QUIET_PARTS), 0.1).otherwise(1.0)
    sure = sure * F.when(bare.startswith("#") | bare.startswith("//"), 0.1).otherwise(1.0)
    return F.greatest(F.lit(0.05), F.when(taint, F.least(sure * 1.2, F.lit(1.0))).otherwise(sure))


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for part in {r[4] for r in SAST_RULES} | set(TAINT_SOURCES):
        found.add_word(part, part)
    found.make_automaton()
    rules: dict[str, list] = {}
    for at, rule in enumerate(SAST_RULES):
        rules.setdefault(rule[4], []).append((at, rule))
    return found, rules, frozenset(TAINT_SOURCES)


def assigned_name(line: str) -> str | None:
    """The plain name, in lower case, that a line's first assignment sets; types and marks of pointers go."""
    bare = line.strip()
    at = _ASSIGNED.search(bare)
    if not at:
        return None
    before = bare[: at.start()].split(":")[0].split()
    name = before[-1].lstrip("*&").lstrip("$") if before else ""
    return name.lower() if name and all(c.isalnum() or c == "_" for c in name) else None


def in_comment(lines: list[str]) -> list[bool]:
    """Whether each line is a comment, by its start or by the block it stands in."""
    out, inside = [], False
    for line in lines:
        bare = line.strip()
        quoted = bare[:3] in ('"""', "'''")
        if inside:
            inside = not ("*/" in bare or quoted)
            out.append(True)
        elif bare.startswith("/*"):
            inside = "*/" not in bare
            out.append(True)
        elif quoted and len(bare) > 3 and '"""' not in bare[3:] and "'''" not in bare[3:]:
            inside = True
            out.append(True)
        else:
            out.append(bare.startswith(("//", "#")))
    return out


def tainted_names(lines: list[str], low: list[str], sources: set[int]) -> set[str]:
    """Names that hold what users control: those assigned on the given lines, and in one pass those that take one over."""
    names = {n for n in (assigned_name(lines[k]) for k in sources) if n}
    for line, x in zip(lines, low, strict=True):
        if names and any(p in x for p in TAINT_PROPAGATORS) and any(n in x for n in names):
            if own := assigned_name(line):
                names.add(own)
    return names


def _shown(line: str, category: str) -> str:
    bare = line.strip()
    if category != "Hardcoded Secrets":
        return bare
    if "=" in bare:
        return bare[: bare.index("=")] + "= [REDACTED]"
    return f"{bare.encode()[:20].decode(errors='ignore')}...[REDACTED]" if len(bare.encode()) > 30 else "[REDACTED — secret detected]"


def scan_text(text: str, path: str, language: str | None, no_code: bool) -> list[tuple]:
    """The findings of a source: (line, rule, CWE, severity, category, confidence, tainted, content), the worst first."""
    found, rules, taint_parts = _automaton()
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    low = [x.lower() for x in lines]
    parts = [{part for _, part in found.iter(x)} for x in low]
    sources = {k for k, p in enumerate(parts) if not p.isdisjoint(taint_parts)}
    wanted = [(k, at, rule) for k, p in enumerate(parts) for part in p for at, rule in rules.get(part, ())]
    if not wanted:
        return []
    names, comment = tainted_names(lines, low, sources), in_comment(lines)
    known = {language, *ALSO.get(language, ())}
    test = 0.4 if any(p in path.lower() for p in TEST_PARTS) else 1.0
    out = []
    for k, at, (name, cwe, severity, category, _, also, clear, languages, taint) in wanted:
        x, plain = low[k], not languages and not taint
        if languages and known.isdisjoint(languages) or no_code and plain and cwe != SECRETS or also and also.lower() not in x:
            continue
        if clear and any(clear.lower() in low[j] for j in range(max(0, k - 1), min(len(low), k + 2))) or comment[k] and cwe != SECRETS:
            continue
        if taint and k not in sources and not any(n in x for n in names):
            continue
        sure = test * (0.1 if any(p in x for p in QUIET_PARTS) else 1.0) * (0.1 if x.lstrip().startswith(("#", "//")) else 1.0)
        sure = max(0.05, min(1.0, sure * 1.2) if taint else sure)
        if sure >= 0.1:
            out.append((-_SEVERITY[severity], k + 1, at, (k + 1, name, cwe, severity, category, sure, taint, _shown(lines[k], category))))
    return [x[3] for x in sorted(out, key=lambda x: x[:3])]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("cwe", T.IntegerType()), T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("tainted", T.BooleanType()), T.StructField("content", T.StringType())])))
def _findings(texts: pd.Series, paths: pd.Series, languages: pd.Series, plain: pd.Series) -> pd.Series:
    keys = ("line", "rule", "cwe", "severity", "category", "confidence", "tainted", "content")
    return pd.Series([[dict(zip(keys, f, strict=True)) for f in scan_text(t or "", p or "", g, bool(n))] for t, p, g, n in zip(texts, paths, languages, plain, strict=True)])


def scan(df: DataFrame, key: str = "doc_id", path: str = "path", text: str = "content") -> DataFrame:
    """Rows (key, line, rule, cwe, severity, category, confidence, tainted, content): the findings of each source."""
    found = _findings(F.col(text), F.col(path), language(F.col(path)), no_code(F.col(path)))
    return df.select(key, F.explode(found).alias("f")).select(key, "f.*")


def severity_weight(severity: Column) -> Column:
    return first_of([(w, severity == name) for name, w in WEIGHTS], 0.0)


def risk(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, findings, critical, high, tainted, risk): 10 (1 - exp(-sum / 4)) of weight, confidence and 1.3 for taint."""
    worth = severity_weight(F.col("severity")) * F.col("confidence") * F.when(F.col("tainted"), 1.3).otherwise(1.0)
    count = lambda c: F.count_if(c)
    return findings.groupBy(key).agg(
        F.count("*").alias("findings"), count(F.col("severity") == "critical").alias("critical"), count(F.col("severity") == "high").alias("high"), count("tainted").alias("tainted"),
        F.round(10 * (1 - F.exp(-F.sum(worth) / 4)), 2).alias("risk"),
    )


def report(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: sources with findings, findings by severity and with taint, the greatest risk and the source that has it."""
    r = risk(findings, key)
    return r.agg(
        F.count("*").alias("sources"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"), F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        F.coalesce(F.sum("tainted"), F.lit(0)).alias("tainted"), F.max("risk").alias("worst_risk"), F.max_by(key, F.struct("risk", -F.col(key))).alias("worst"),
    )
