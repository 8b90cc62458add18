"""Column functions on text: words, identifiers, paths, boilerplate, and queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    BOILERPLATE_LINES, BOILERPLATE_STARTS, CODE_STOP_WORDS, CONFIG_FILES, CONTRACT_WORDS, GENERIC_VERBS, INFRASTRUCTURE_ENDS, LAYERS, OTHER_SOURCE_WEIGHT,
    PATH_STOP_WORDS, SAFETY_FILES, SOURCE_WEIGHTS, SPECIFIC_WORDS, STOP_WORDS, TASKS, TEST_ENDS, TYPE_ENDS, TYPE_FILES,
)

WORD = r"[\p{L}\p{N}_]+"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(col: Column, parts) -> Column:
    return any_of(col.contains(p) for p in parts)


def ends_with_any(col: Column, ends) -> Column:
    return any_of(col.endswith(e) for e in ends)


_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?-iu:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def folded(pattern: str) -> str:
    """A pattern of RE2 for rlike, without regard to case.

    Java's own \\b takes letters such as ü for parts of words, folds only ASCII unless told so, has . stop at more than
    line feeds, $ at a last line feed, and \\s at vertical tabs.
    """
    out, inside = [], False
    for t in re.findall(r"\\.|.", pattern, re.S):
        inside = t == "[" or inside and t != "]"
        out.append({r"\s": r"\t\n\f\r\x20"}.get(t, t) if inside else {r"\b": _EDGE, r"\s": r"[\t\n\f\r\x20]", "$": r"\z"}.get(t, t))
    return "(?iud)" + "".join(out)


def token_count(text: Column) -> Column:
    """A quarter of the bytes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Words of two bytes or more that are no stop words."""
    return F.filter(words_of(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS))


def code_terms(text: Column) -> Column:
    """Words of two bytes or more that are not among the stop words of code; lower-case words have no parts."""
    return F.filter(words_of(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*CODE_STOP_WORDS))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of a name at underscores, before capitals, and before the last capital of a run."""
    cut = F.regexp_replace(F.regexp_replace(name, r"(?<=[^\p{Lu}_])(?=\p{Lu})", "_"), r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.split(F.lower(cut), "_+"), lambda p: p != "")


def path_terms(path: Column) -> Column:
    parts = F.split(F.lower(path), r"[/\\.\-_]")
    return F.filter(parts, lambda p: (F.octet_length(p) >= 2) & ~p.isin(*PATH_STOP_WORDS))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def directory_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def basename_of(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def path_depth(path: Column) -> Column:
    """Separators in a path, without the mark file: before it."""
    clean = F.regexp_replace(path, "^file:", "")
    return F.length(clean) - F.length(F.translate(clean, "/\\", ""))


def is_boilerplate(line: Column) -> Column:
    starts = any_of(line.startswith(s) for s in BOILERPLATE_STARTS)
    dunder = line.startswith("def __") & line.contains("__(")
    package = line.startswith("package ") & ~line.contains("{")
    return (line == "") | line.isin(*BOILERPLATE_LINES) | starts | dunder | package


def boilerplate_ratio(text: Column) -> Column:
    """Share of the lines that are not blank which carry no content; 1 if all are blank."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    return F.when(F.size(lines) == 0, 1.0).otherwise(F.size(F.filter(lines, is_boilerplate)) / F.size(lines))


def source_weight(path: Column) -> Column:
    low = F.lower(path)
    out = None
    for weight, ends in SOURCE_WEIGHTS:
        hit = ends_with_any(low, ends)
        if weight == 0.40:
            hit = low.contains("dockerfile") | hit
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(OTHER_SOURCE_WEIGHT)


def criticality(path: Column) -> Column:
    """safety, critical, important or normal."""
    low = F.lower(path)
    base, root = basename_of(low), path_depth(low) <= 1
    important = base.isin(*TYPE_FILES) | ends_with_any(base, TYPE_ENDS)
    tests = base.startswith("test_") | ends_with_any(base, TEST_ENDS)
    by_depth = F.when(root, "critical").otherwise("important")
    return (
        F.when(base.isin(*SAFETY_FILES), "safety")
        .when(base.isin(*CONFIG_FILES), by_depth)
        .when(important, "important")
        .when(ends_with_any(base, INFRASTRUCTURE_ENDS), by_depth)
        .when(tests | has_any(base, CONTRACT_WORDS), "important")
        .otherwise("normal")
    )


def has_safety_signal(text: Column) -> Column:
    """Private keys, or assignments of secrets outside comments."""
    low = F.lower(text)
    comment = lambda x: any_of(x.startswith(s) for s in ("#", "//", "/*", "*", "-", '"""', "'''"))
    lines = F.transform(F.split(low, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+", ""))
    assigned = F.exists(lines, lambda x: ~comment(x) & x.contains("=") & has_any(x, ("secret_key", "api_key", "private_key")))
    return has_any(low, ("-----begin private key-----", "-----begin rsa private key-----", "aws_secret_access_key")) | assigned


def task_type(query: Column) -> Column:
    low, out = F.lower(query), None
    for name, _, parts in TASKS:
        out = (F if out is None else out).when(has_any(low, parts), name)
    return out.otherwise("unknown")


def budget_multiplier(task: Column) -> Column:
    out = None
    for name, factor, _ in TASKS:
        out = (F if out is None else out).when(task == name, factor)
    return out.otherwise(1.0)


def vagueness(query: Column) -> Column:
    """0 (specific) to 1 (vague), to 3 places."""
    terms = query_terms(query)
    n = F.size(terms)
    generic = F.size(F.filter(terms, lambda t: has_any(t, GENERIC_VERBS)))
    specific = F.size(F.filter(terms, lambda t: has_any(t, SPECIFIC_WORDS)))
    named = F.exists(spaced_words(query), lambda w: (F.octet_length(w) > 4) & w.rlike(r"\p{Lu}") & w.rlike(r"[^\p{Lu}]"))
    short = F.when(n < 3, 0.7).when(n < 5, 0.4).when(n < 7, 0.15).otherwise(0.0)
    bonus = F.least(specific * 0.15 + F.when(named, 0.2).otherwise(0.0), F.lit(0.4))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), generic / n * 0.5 + short * 0.3 - bonus * 0.7))
    return F.when(n == 0, 1.0).otherwise(F.floor(raw * 1000 + 0.5) / 1000)


def layer(text: Column) -> Column:
    """The place of the first layer that has a word in the text, else null."""
    low, out = F.lower(text), None
    for k, (_, parts) in enumerate(LAYERS):
        out = (F if out is None else out).when(has_any(low, parts), k)
    return out


def softcap(x: Column, cap: float = 0.85) -> Column:
    return F.least(x, F.lit(1.0)) if cap <= 0 or cap >= 10 else cap * F.tanh(x / cap)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
