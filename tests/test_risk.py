"""The risk of claims: features, fitting and thresholds against plain Python over whole small tables and made-up cases."""

import math
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest

from siftwork.operators import risk
from siftwork.plans import QUERIES
from siftwork.plans.risk import claims, featured

WORD, NUMBER = re.compile(r"[A-Za-z][A-Za-z0-9_'-]+"), re.compile(r"\b\d+(?:\.\d+)?\b")
NAME = re.compile(r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b")


def words(t):
    return {w.lower() for w in WORD.findall(t) if w.lower() not in risk.EMPTY_WORDS and len(w) > 2}


def parts(t):
    return [s for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def missing(what, there):
    gone = sum(not there(x) for x in what)
    return 0.0 if not what else 1.0 if not gone else -gone / len(what)


def plain(claim, context, question, weight=None):
    c, x, q = claim or "", context or "", question or ""
    cl, xl, cw, xw = c.lower(), x.lower(), words(c), words(x)
    people = set()
    for s in parts(c):
        s = s.strip()
        opening = s.split(None, 1)[0].rstrip(",.!?:;")
        people |= {m.lower() for m in NAME.findall(s) if m != opening or m.lower() not in risk.OPENINGS}
    nums, shared = set(NUMBER.findall(c)), cw & xw
    common = lambda w: 1.0 / (1.0 + math.log(1 + xl.count(w)))
    weight = weight or common
    quote = SequenceMatcher(None, cl, xl, autojunk=False).find_longest_match(0, len(cl), 0, len(xl)).size / max(1, len(c)) if c and x else 0.0

    def denied(t, w):
        at = t.find(w)
        return at > 0 and any(n in t[max(0, at - 30) : at] for n in risk.NEGATIONS)

    polarity = 0.0 if not shared else -1.0 if any(denied(cl, w) != denied(xl, w) for w in shared) else 1.0
    share = len(shared) / len(cw) if cw else 1.0
    lex = 1.0 if not cw else 0.0 if not shared else sum(map(weight, shared)) / max(1e-9, sum(map(weight, cw)))
    return [missing(people, lambda p: p in xl), missing(nums, lambda n: n in set(NUMBER.findall(x))), lex, quote, 0.5 * quote + 0.5 * share if cw else 1.0, share, polarity, 0.5, aligned(cl, cw, nums, xl, words(q) if q.strip() else set(), common)]


def aligned(cl, cw, nums, xl, qw, common):
    if not qw or not xl.strip() or not (cw or nums):
        return 0.0
    best, top = "", -1.0
    for s in parts(xl) or [xl]:
        sw = set(WORD.findall(s))
        score = round(sum(common(w) for w in qw & sw) + 0.1 * sum(common(w) for w in cw & sw), 9)
        if score > top:
            best, top = s, score
    if top <= 0:
        return 0.0
    bw, bn = set(WORD.findall(best)), set(NUMBER.findall(best))
    score = sum(common(w) for w in cw & bw) / sum(map(common, cw)) if cw else 1.0
    if nums:
        numeric = len(nums & bn) / len(nums)
        score = 0.5 * score + 0.5 * numeric if cw else numeric
    bare = cl.strip(" .,!?\"'")
    raw = min(1.0, score + (0.3 if len(bare) >= 2 and bare in best else 0.0))
    if len(qw & bw) >= 2 and raw < 0.2:
        if nums and not nums & bn and nums & set(NUMBER.findall(xl)):
            return -1.0
        if cw:
            return -(0.2 - raw) / 0.2
    return raw


CASES = [
    ("Einstein developed relativity in 1915.", "Albert Einstein developed general relativity in 1915. He won the Nobel Prize in 1921.", "what year did Einstein develop general relativity"),
    ("1921", "Albert Einstein developed general relativity in 1915. He won the Nobel Prize in 1921.", "when did Einstein develop general relativity"),
    ("Bohr developed general relativity.", "Albert Einstein developed general relativity in 1915.", None),
    ("The cache is not safe for threads.", "The cache is safe for threads.", "is the cache safe"),
    ("Princeton.", "He worked at Princeton University. The town lies in New Jersey! It's a place.", "where did he work at the University"),
    ("zebra crossing", "The parser reads settings from disk. It never writes them.", "what does the parser read from disk settings"),
    (None, "text", "q"), ("claim", None, "q"), ("", "", ""), ("a b", "Of it 3.5 and 4", "the of"), ("Of 3.5 and 7", "Of it 3.5 and 4", "which numbers, it says: 3.5?"),
    ("However we saw Ünal Smith at Café Noir 12é 13", "we saw Ünal Smith at Café Noir 12é 13", "who saw Smith at Noir"), ("CamelCase_word don't re-use", "they re-use camelcase_word; don't don't", "don't re-use what?"),
]


def test_features_of_cases(spark):
    df = spark.createDataFrame([(k, *c, "own") for k, c in enumerate(CASES)], "k int, claim string, context string, question string, _best string")
    for r in risk.features(df).collect():
        assert [round(r[n], 6) for n in risk.FEATURES] == [round(v, 6) for v in plain(*CASES[r.k])], CASES[r.k]


def test_features_of_whole_tables(spark, sf):
    """With weights from the corpus, joined."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    df = Counter(w for t in texts for w in words(t))
    weight = lambda w: 1 + math.log((len(texts) + 1) / (df[w] + 1)) if df[w] else 1.0
    found = {(r.conv_id, r.turn): r for r in QUERIES["wit14_claim_features"](spark, sf).collect()}
    rows = claims(spark, sf).collect()
    assert len(rows) == len(found) and {r.y for r in rows} == {0, 1}
    for r in rows:
        want = plain(r.claim, r.context, r.question, weight)
        assert [found[r.conv_id, r.turn][n] for n in risk.FEATURES] == pytest.approx([round(v, 6) for v in want], abs=2e-6)


def forward(x, w, b):
    """Risks of rows of features, by numpy."""
    z, alive = np.full(len(x), b), np.ones(len(x))
    for k, n in enumerate(risk.FEATURES):
        against = (x[:, k] < 0) & (n in risk.GATES)
        z += np.where(against, 0.0, w[k] * np.maximum(0.0, x[:, k]))
        alive *= np.where(against, 1 - np.minimum(1.0, -x[:, k]), 1.0)
    return 1 - (1 - 1 / (1 + np.exp(-z))) * alive


def descend(x, y, epochs, rate=0.5):
    w, b = np.array(list(risk.WEIGHTS.values())), risk.BIAS
    for step in range(epochs):
        off, now = forward(x, w, b) - y, rate / (1 + step / 100)
        w, b = np.clip(w - now * (off[:, None] * x).mean(axis=0), -10, 10), float(np.clip(b - now * off.mean(), -10, 10))
    return w, b


def matrix(rows):
    return np.array([[r[n] for n in risk.FEATURES] for r in rows])


def test_fit_is_numpys(spark, sf):
    f = featured(spark, sf)
    rows = f.collect()
    some = [r for r in rows if r.conv_id % 4 != 3]
    w, b = descend(matrix(some), np.array([r.y for r in some]), 20)
    want = forward(matrix(rows), w, b)
    got = {(r.conv_id, r.turn): r.risk for r in QUERIES["wit18_fitted_risk"](spark, sf).collect()}
    assert all(abs(got[r.conv_id, r.turn] - p) < 1e-5 for r, p in zip(rows, want, strict=True))
    assert risk.fit(f.limit(0)) == (risk.WEIGHTS, risk.BIAS)


def quantile(values, alpha):
    values = sorted(values)
    return values[max(1, min(len(values), math.ceil((len(values) + 1) * (1 - alpha)))) - 1] if values else 1.0


def test_thresholds_and_coverage(spark):
    """Ties, a profile without what is made up, and the promise on rows that were not calibrated with."""
    rng = random.Random(4)
    rows = [(p, round(min(1.0, max(0.0, rng.gauss(0.7 if y else 0.3, 0.2))), 2), y) for p, n in (("qa", 900), ("chat", 60), ("one", 1)) for y in (0, 1) for _ in range(n)] + [("safe", 0.2, 0)] * 5
    got = {r.p: r for r in risk.calibrate(spark.createDataFrame(rows, "p string, r double, y int"), "p", "r", "y").collect()}
    for p in ("qa", "chat", "one", "safe"):
        bad, good = [r for q, r, y in rows if q == p and y], [r for q, r, y in rows if q == p and not y]
        taus = sorted(quantile(bad, a) for a in (0.8, 0.5, 0.2))
        exposure = round(sum(r < taus[2] for r in bad) / max(1, len(bad)), 4)
        assert (got[p].tau_pass, got[p].tau_hedge, got[p].tau_warn, got[p].n, got[p].made_up) == (*taus, len(bad) + len(good), len(bad))
        assert got[p].exposure == exposure and got[p].retention == round(sum(r < taus[0] for r in good) / max(1, len(good)), 4)
    later = [min(1.0, max(0.0, rng.gauss(0.7, 0.2))) for _ in range(5000)]
    assert sum(r <= got["qa"].tau_warn for r in later) / 5000 >= 0.8 - 0.04
    with pytest.raises(ValueError):
        risk.calibrate(spark.createDataFrame(rows, "p string, r double, y int"), "p", "r", "y", (0.2, 0.5, 0.8))


def test_thresholds_of_the_query(spark, sf):
    profile = {(r.conv_id, r.turn): r.profile for r in claims(spark, sf).collect()}
    by = defaultdict(list)
    for r in QUERIES["wit18_fitted_risk"](spark, sf).where("held_out and y = 1").collect():
        by[profile[r.conv_id, r.turn]].append(r.risk)
    for r in QUERIES["wit19_thresholds"](spark, sf).collect():
        assert [r.tau_pass, r.tau_hedge, r.tau_warn] == sorted(quantile(by[r.profile], a) for a in (0.8, 0.5, 0.2))


def test_actions_and_record(spark, sf):
    f = featured(spark, sf)
    rows = f.collect()
    x, usual = matrix(rows), np.array(list(risk.WEIGHTS.values()))
    p = forward(x, usual, risk.BIAS)
    got = {(r.conv_id, r.turn): r.action for r in QUERIES["wit19_actions"](spark, sf).collect()}
    for r, q in zip(rows, p, strict=True):
        taus = risk.THRESHOLDS[{"assistant": "qa", "user": "chat"}.get(r.profile, "summary")]
        assert got[r.conv_id, r.turn] == (["pass", "hedge", "warn", "suppress"][sum(q >= t for t in taus)])
    known = [k for k, r in enumerate(rows) if r.turn % 5 != 4]
    y = np.array([rows[k].y for k in known])
    w, b = descend(x[known], y, 1)
    after, by = forward(x, w, b), defaultdict(list)
    for k in known:
        label = {(1, 0): "ci_failed", (1, 1): " Rejected ", (0, 0): "grounded", (0, 1): "accepted"}[rows[k].y, rows[k].turn % 2]
        by[rows[k].profile, label, rows[k].y].append(k)
    audit = {(r.profile, r.label, r.y): r for r in QUERIES["wit21_training_record"](spark, sf).collect()}
    assert set(audit) == set(by)
    for key, ks in by.items():
        assert audit[key].n == len(ks) and abs(audit[key].before - p[ks].mean()) < 2e-6 and abs(audit[key].after - after[ks].mean()) < 2e-6
