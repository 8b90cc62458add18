"""The risk that a claim is made up: features of claim, evidence and question, a logistic model fitted by sums, and thresholds with a promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import quoted_share
from .knowledge import continuous_risk
from .learning import conformal_quantile

# --- fixed values: signs of negation, words without content, openings that are no names, first weights, bias and bound, thresholds, labels ---
NEGATIONS = (
    "is not", "are not", "was not", "were not", "does not", "do not", "did not", "has not", "have not", "had not", "will not", "would not", "cannot", "can not", "isn't", "aren't", "wasn't", "weren't", "doesn't",
    "don't", "didn't", "hasn't", "haven't", "hadn't", "won't", "wouldn't", "no ", "not ", "never ", "none ",
)
EMPTY_WORDS = tuple("a an and as at be by for from has have in into is it of on or that the to was were will with would could should may might can do does did been being".split())
OPENINGS = tuple("the this that these those a an it they we i you he she but and or so however moreover furthermore therefore thus hence indeed actually interestingly importantly specifically additionally consequently yet still call use run read write return update create delete".split())
FEATURES = ("entity_precision", "number_consistency", "idf_lex_overlap", "quote_support", "forward_entail", "reverse_entail", "negation_polarity", "adequacy", "qa_alignment")
WEIGHTS = dict(zip(FEATURES, (-1.4, -3.2, -1.2, -2.4, -1.8, -2.6, -3.0, -0.8, -2.8), strict=True))
BIAS, BOUND, GATES = 6.0, 10.0, ("number_consistency", "negation_polarity", "entity_precision", "qa_alignment")
THRESHOLDS = {
    "benchmark_qa": (0.35, 0.55, 0.80), "qa": (0.35, 0.55, 0.80), "rag": (0.35, 0.55, 0.80), "code": (0.30, 0.50, 0.75), "summary": (0.40, 0.60, 0.78), "dialogue": (0.45, 0.65, 0.82), "chat": (0.45, 0.65, 0.85), "auto": (0.40, 0.60, 0.80),
}
SAFE = ("safe", "grounded", "accepted", "user_accepted", "ci_passed", "test_passed", "tests_passed", "command_succeeded", "false_positive")
MADE_UP = ("hallucinated", "unsupported", "rejected", "user_rejected", "ci_failed", "test_failed", "tests_failed", "command_failed", "false_negative", "witness_correct")
NEAR = 30

_WORD, _EDGE = "[A-Za-z][A-Za-z0-9_'-]+", r"[\p{L}\p{N}_]"
_NUMBER = rf"(?<!{_EDGE})\d+(?:\.\d+)?(?!{_EDGE})"
_NAME = rf"(?<!{_EDGE})[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*(?!{_EDGE})"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def content_words(text: Column) -> Column:
    """Different words in lower case, of over two letters, without those that carry no content."""
    return F.array_distinct(F.filter(F.transform(_all(text, _WORD), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*EMPTY_WORDS)))


def names(text: Column) -> Column:
    """Runs of capitalised words in lower case; a sentence's first word is none if sentences are often opened with it."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    opening = lambda s: F.regexp_replace(F.element_at(F.split(s, r"\s+", 2), 1), r"[,.!?:;]+$", "")
    each = F.transform(parts, lambda s: F.filter(_all(s, _NAME), lambda m: (m != opening(s)) | ~F.lower(m).isin(*OPENINGS)))
    return F.array_distinct(F.transform(F.flatten(each), F.lower))


def _missing(what: Column, there) -> Column:
    """1 if all of an array is there, less than 0 by the share that is not, 0 if it is empty."""
    gone = F.size(F.filter(what, lambda x: ~there(x)))
    return F.when(F.size(what) == 0, 0.0).when(gone == 0, 1.0).otherwise(-gone / F.size(what))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _commonness(text: str, word: Column) -> Column:
    """The weight of a word that a text has more or less often."""
    n = (F.length(text) - F.length(F.replace(F.col(text), word, F.lit("")))) / F.length(word)
    return 1.0 / (1.0 + F.log(1.0 + n))


def _aligned(answer: str) -> Column:
    """How much of the answer stands in the sentence that the question is about, by columns _q, _a, _an (words and numbers with weights), _best; see features()."""
    best = F.col("_best")
    words, numbers = _all(best, _WORD), _all(best, _NUMBER)
    inside = lambda rows: F.filter(rows, lambda x: F.array_contains(words, x["word"]))
    weight = lambda rows: _sum(F.transform(rows, lambda x: x["weight"]))
    has_words, has_numbers = F.size("_a") > 0, F.size("_an") > 0
    by_word = F.when(has_words, weight(inside(F.col("_a"))) / weight(F.col("_a"))).otherwise(1.0)
    found = F.size(F.filter("_an", lambda n: F.array_contains(numbers, n)))
    by_number = found / F.size("_an")
    score = F.when(has_numbers & has_words, 0.5 * by_word + 0.5 * by_number).when(has_numbers, by_number).otherwise(by_word)
    bare = F.regexp_replace(F.lower(answer), r"^[ .,!?\"']+|[ .,!?\"']+$", "")
    raw = F.least(F.lit(1.0), score + F.when((F.length(bare) >= 2) & best.contains(bare), 0.3).otherwise(0.0))
    elsewhere = F.size(F.filter("_an", lambda n: F.array_contains(F.col("_kn"), n))) > 0
    sure = (F.size(inside(F.col("_q"))) >= 2) & (raw < 0.2)
    return F.when(sure & has_numbers & (found == 0) & elsewhere, -1.0).when(sure & has_words, -(0.2 - raw) / 0.2).otherwise(raw)


def features(rows: DataFrame, claim: str = "claim", context: str = "context", question: str = "question", adequacy: str | None = None, idf: DataFrame | None = None) -> DataFrame:
    """rows with a column for each of FEATURES, from -1 to 1: negative ones speak against the claim, 0 says nothing.

    Names and numbers of the claim in the context; weighted share of its words (by a table idf of (word, weight),
    joined, or by how often the context has them); the longest run it shares, and that with the share of words;
    negation on one side only; and whether it stands in the sentence that the question is about. Null texts count
    as empty. The words are joined to idf by an aggregation over rows that __at numbers, so rows may repeat.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = rows.withColumn("__at", F.monotonically_increasing_id()) if idf is not None else rows
    r = r.withColumns({"_c": text(claim), "_x": text(context), "_u": text(question)}).withColumns({"_cl": F.lower("_c"), "_xl": F.lower("_x")})
    r = r.withColumns({"_cw": content_words(F.col("_c")), "_xw": content_words(F.col("_x")), "_names": names(F.col("_c")), "_an": F.array_distinct(_all(F.col("_c"), _NUMBER)), "_xn": F.array_distinct(_all(F.col("_x"), _NUMBER)), "_qw": content_words(F.col("_u"))})
    r = r.withColumn("_shared", F.array_intersect("_cw", "_xw"))
    r = r.withColumns({"_a": F.transform("_cw", lambda w: F.struct(w.alias("word"), _commonness("_xl", w).alias("weight"))), "_q": F.transform("_qw", lambda w: F.struct(w.alias("word"), _commonness("_xl", w).alias("weight")))})
    if idf is not None:
        words = r.select("__at", F.explode("_cw").alias("word"), "_shared").join(idf.select("word", "weight"), "word", "left")
        weight = F.coalesce("weight", F.lit(1.0))
        sums = words.groupBy("__at").agg(F.sum(weight).alias("_all"), F.coalesce(F.sum(F.when(F.array_contains("_shared", F.col("word")), weight)), F.lit(0.0)).alias("_met"))
        r = r.join(sums, "__at", "left").drop("__at")
        overlap = F.col("_met") / F.greatest("_all", F.lit(1e-9))
    else:
        of = lambda keep: _sum(F.transform(F.filter("_a", keep), lambda x: x["weight"]))
        overlap = of(lambda x: F.array_contains(F.col("_shared"), x["word"])) / F.greatest(of(lambda x: F.lit(True)), F.lit(1e-9))
    none, apart = F.size("_cw") == 0, F.size("_shared") == 0
    share = F.size("_shared") / F.size("_cw")
    r = r.withColumn("quote_support", quoted_share(F.col("_c"), F.col("_x")))
    before = lambda t, w: F.when(F.instr(F.col(t), w) > 1, F.substring(F.col(t), F.greatest(F.instr(F.col(t), w) - NEAR, F.lit(1)), F.least(F.instr(F.col(t), w) - 1, F.lit(NEAR)))).otherwise("")
    denied = lambda t, w: F.exists(F.array(*[F.lit(n) for n in NEGATIONS]), lambda n: before(t, w).contains(n))
    r = r.withColumns({
        "entity_precision": _missing(F.col("_names"), lambda x: F.col("_xl").contains(x)), "number_consistency": _missing(F.col("_an"), lambda x: F.array_contains("_xn", x)),
        "idf_lex_overlap": F.when(none, 1.0).when(apart, 0.0).otherwise(overlap), "forward_entail": F.when(none, 1.0).otherwise(0.5 * F.col("quote_support") + 0.5 * share), "reverse_entail": F.when(none, 1.0).otherwise(share),
        "negation_polarity": F.when(apart, 0.0).when(F.exists("_shared", lambda w: denied("_cl", w) != denied("_xl", w)), -1.0).otherwise(1.0), "adequacy": F.col(adequacy).cast("double") if adequacy else F.lit(0.5),
    })
    # the sentence that has most of the question's words, a tenth of the answer's counted in; the first of equals
    weigh = lambda ws, rows_: _sum(F.transform(F.filter(rows_, lambda x: F.array_contains(ws, x["word"])), lambda x: x["weight"]))
    parts = F.filter(F.split("_xl", r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"\s+", "") != "")
    r = r.withColumn("_parts", F.transform(parts, lambda s, i: F.struct(_all(s, _WORD).alias("words"), (-i).alias("i"), s.alias("s"))))
    r = r.withColumn("_scored", F.transform("_parts", lambda p: F.struct(F.round(weigh(p["words"], F.col("_q")) + 0.1 * weigh(p["words"], F.col("_a")), 9).alias("score"), p["i"].alias("i"), p["s"].alias("s"))))
    r = r.withColumn("_top", F.array_max("_scored")).withColumns({"_best": F.coalesce("_top.s", F.lit("")), "_kn": F.col("_xn")})
    silent = (F.trim("_u") == "") | (F.trim("_x") == "") | (F.size("_qw") == 0) | ((F.size("_a") == 0) & (F.size("_an") == 0)) | (F.coalesce("_top.score", F.lit(0.0)) <= 0)
    r = r.withColumn("qa_alignment", F.when(silent, 0.0).otherwise(_aligned("_c")))
    return r.select(*rows.columns, *FEATURES)


def corpus_idf(texts: DataFrame, text: str) -> DataFrame:
    """Rows (word, weight): 1 + ln((n + 1) / (texts that have the word + 1))."""
    n = texts.agg(F.count("*").alias("n"))
    words = texts.select(F.explode(content_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return words.crossJoin(F.broadcast(n)).select("word", (1.0 + F.log((F.col("n") + 1.0) / (F.col("df") + 1.0))).alias("weight"))  # one row


def predicted(weights: dict[str, float] = WEIGHTS, bias: float = BIAS) -> Column:
    """The risk: a logistic part of what speaks for the claim, and a gate for each feature that speaks against it."""
    return continuous_risk({n: (F.col(n), weights[n]) for n in FEATURES}, GATES, bias)


def gradient(rows: DataFrame, weights: dict[str, float], bias: float, y: str) -> tuple[dict[str, float], float, int]:
    """(means of (risk - y) times each feature, mean of risk - y, rows): one aggregate, ten numbers to the driver."""
    off = F.col("_p") - F.col(y)
    found = rows.withColumn("_p", predicted(weights, bias)).agg(F.count("*").alias("n"), F.avg(off).alias("_bias"), *[F.avg(off * F.col(n)).alias(n) for n in FEATURES]).first()
    return {n: found[n] or 0.0 for n in FEATURES}, found["_bias"] or 0.0, found["n"]


def fit(rows: DataFrame, y: str = "y", epochs: int = 20, rate: float = 0.5, weights: dict[str, float] = WEIGHTS, bias: float = BIAS) -> tuple[dict[str, float], float]:
    """(weights, bias) after so many steps down the mean gradient, each bounded to ten.

    rows have FEATURES and a label, 1 for what is made up; write them first, as every step reads them. The rate of
    a step is over 1 more than a hundredth of the steps before it. No row reaches the driver; no rows change nothing.
    """
    weights = dict(weights)
    held = lambda x: max(-BOUND, min(BOUND, x))
    for step in range(epochs):
        means, off, n = gradient(rows, weights, bias, y)
        if not n:
            break
        now = rate / (1.0 + step / 100.0)
        weights = {k: held(w - now * means[k]) for k, w in weights.items()}
        bias = held(bias - now * off)
    return weights, bias


def calibrate(rows: DataFrame, profile: str, risk: str, y: str, alphas: tuple[float, float, float] = (0.80, 0.50, 0.20)) -> DataFrame:
    """Rows (profile, tau_pass, tau_hedge, tau_warn, n, made_up, exposure, retention) of labelled risks.

    A threshold is the conformal quantile of the risks of what is made up: of a further such claim the chance to
    lie at or under tau_warn is at least 1 - alpha. exposure is the share of them below tau_warn, retention that of
    safe claims below tau_pass. Risks count to six places, so a profile's quantile is found among a million counts
    at most. Profiles without a claim that is made up have thresholds of 1.
    """
    if not alphas[2] < alphas[1] < alphas[0]:
        raise ValueError("alphas have to fall from pass to warn")
    r = rows.select(profile, F.round(risk, 6).alias("_r"), F.col(y).alias("_y"))
    taus = r.select(profile).distinct()
    for k, a in enumerate(alphas):
        taus = taus.join(conformal_quantile(r.where("_y = 1"), profile, "_r", a).withColumnRenamed("q", f"_q{k}"), profile, "left")
    ordered = F.array_sort(F.array(*[F.coalesce(f"_q{k}", F.lit(1.0)) for k in range(3)]))
    taus = taus.select(F.col(profile).alias("_p"), *[F.element_at(ordered, k + 1).alias(n) for k, n in enumerate(("tau_pass", "tau_hedge", "tau_warn"))])
    joined = r.join(F.broadcast(taus), F.col(profile) == F.col("_p"))  # a row a profile
    bad, safe = F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)
    over = lambda k: F.greatest(k, F.lit(1))
    return joined.groupBy(profile, "tau_pass", "tau_hedge", "tau_warn").agg(
        F.count("*").alias("n"), bad.alias("made_up"),
        F.round(F.count_if((F.col("_y") == 1) & (F.col("_r") < F.col("tau_warn"))) / over(bad), 4).alias("exposure"), F.round(F.count_if((F.col("_y") == 0) & (F.col("_r") < F.col("tau_pass"))) / over(safe), 4).alias("retention"),
    )


def default_thresholds(profile: Column) -> Column:
    """(pass, hedge, warn) of a kind of work where nothing is calibrated."""
    key = F.regexp_replace(F.lower(F.coalesce(profile, F.lit("auto"))), "-", "_")
    key, out = F.when(key == "summarization", "summary").otherwise(key), None
    triple = lambda t: F.struct(*[F.lit(x).alias(n) for n, x in zip(("tau_pass", "tau_hedge", "tau_warn"), t, strict=True)])
    for name, t in THRESHOLDS.items():
        out = (F if out is None else out).when(key == name, triple(t))
    return out.otherwise(triple(THRESHOLDS["auto"]))


def action(risk: Column, tau_pass: Column, tau_hedge: Column, tau_warn: Column) -> Column:
    return F.when(risk < tau_pass, "pass").when(risk < tau_hedge, "hedge").when(risk < tau_warn, "warn").otherwise("suppress")


def label_y(label: Column) -> Column:
    """1 for labels of what is made up, 0 for those of what is safe, null for others."""
    known = F.lower(F.trim(label))
    return F.when(known.isin(*SAFE), 0).when(known.isin(*MADE_UP), 1)


def record(rows: DataFrame, profile: str, label: str, weights: dict[str, float] = WEIGHTS, bias: float = BIAS, rate: float = 0.5) -> tuple[DataFrame, dict[str, float], float]:
    """(audit, weights, bias): one step on newly labelled claims, and for each profile and label how mean risk moved by it.

    rows have FEATURES; those whose label is not known take no part.
    """
    known = rows.withColumn("_y", label_y(F.col(label))).where("_y is not null")
    after, off = fit(known, "_y", 1, rate, weights, bias)
    moved = known.withColumns({"_before": predicted(weights, bias), "_after": predicted(after, off)})
    audit = moved.groupBy(profile, label, "_y").agg(F.count("*").alias("n"), F.avg("_before").alias("before"), F.avg("_after").alias("after")).withColumnRenamed("_y", "y")
    return audit, after, off
