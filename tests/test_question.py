"""Selection for questions, against plain Python over whole small tables and generated ones."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions.routing_values import SENTENCE_STOP_WORDS
from siftwork.operators import question
from siftwork.plans import QUERIES
from siftwork.plans.question import BUDGET, OPEN_BUDGET

CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+")


def terms(text):
    out = []
    for name in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text or ""):
        low = name.lower()
        parts = {low, *(p for p in low.split("_") if len(p) > 2), *(p.lower() for p in CAMEL.findall(name) if len(p) > 2)}
        out += [p for p in parts if p not in SENTENCE_STOP_WORDS]
    return out


def bm25(asked, texts):
    counts = [Counter(terms(t)) for t in texts]
    df, n = Counter(x for c in counts for x in c), len(texts)
    avg = max(1.0, sum(sum(c.values()) for c in counts) / max(1, n))
    out = []
    for c in counts:
        norm = 1 - 0.75 + 0.75 * sum(c.values()) / avg
        out.append(round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * norm) for t in asked if c[t]), 9))
    return out


def cut(text):
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|(?<=\n\n)|(?<=;\n)|(?<=\}\n)", text)) if len(s) >= 20]


def plain_shares(asked, files, budget):
    scores = sorted(((s, k) for s, k in zip(bm25(asked, [t for _, t in files]), [k for k, _ in files], strict=True) if s > 0), reverse=True)[:12]
    total = sum(s for s, _ in scores)
    return [(k, s, max(256, int(budget * (s / total)))) for s, k in scores]


def plain_excerpts(asked, files, budget):
    left, out, texts = budget, [], dict(files)
    for place, (k, _, share) in enumerate(plain_shares(asked, files, budget), 1):
        if left <= 0:
            break
        s = cut(texts[k])
        rel, sets, room = bm25(asked, s), [set(terms(x)) for x in s], min(share, left)
        open_, picked, used = [i for i in range(len(s)) if rel[i] > 0], [], 0
        while open_ and used < room:
            near = lambda i: max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0 for j in picked), default=0.0)
            worth = lambda i: round(0.7 * rel[i] - (1 - 0.7) * near(i) if picked else rel[i], 9)
            i = max(open_, key=lambda i: (worth(i), -i))
            open_.remove(i)
            cost = max(1, len(s[i]) // 4)
            if used + cost <= room:
                picked.append(i)
                used += cost
        if picked:
            e = "\n".join(s[i] for i in sorted(picked))
            out.append((place, k, max(1, len(e) // 4), e))
            left -= max(1, len(e) // 4)
    return out


@pytest.fixture(scope="module")
def tables(spark, sf):
    get = lambda n: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").collect()]
    return {"documents": [(r[0], r[1]) for r in get("documents")], "benchmark": get("benchmark"), "conversations": [(c, t, x) for c, t, _, x in get("conversations")]}


def test_shares_and_excerpts_of_whole_tables(spark, sf, tables):
    got, shared = defaultdict(list), defaultdict(list)
    for r in QUERIES["ret10_question_excerpts"](spark, sf).orderBy("item_id", "place").collect():
        got[r.item_id].append((r.place, r.doc_id, r.tokens, r.excerpt))
    for r in QUERIES["ret10_budget_shares"](spark, sf).orderBy("item_id", "place").collect():
        shared[r.item_id].append((r.doc_id, r.score, r.share))
    for item, text in tables["benchmark"]:
        asked = set(terms(text))
        want = plain_excerpts(asked, tables["documents"], BUDGET)
        assert got[item] == [(p, k, t, hashlib.md5(e.encode()).hexdigest()) for p, k, t, e in want]
        assert sum(t for _, _, t, _ in got[item]) <= BUDGET + 12
        assert [(k, s) for k, _, s in shared[item]] == [(k, s) for k, _, s in plain_shares(asked, tables["documents"], BUDGET)]


def test_excerpts_of_code_and_edges(spark):
    """Code cut at braces and semicolons, nulls, files without a match, sentences that do not fit."""
    files = [(1, "def load_config(path):\n    return parseConfig(path);\nfn other() { load_config(a) }\nThe parser reads HTTPServer settings. Nothing else."), (2, None), (3, ""), (4, "parse " * 900 + "config."), (5, "load config load config here it is.\n\nload config again, the same words here it is."), (None, "parse config")]
    asked = [(1, "how does parseConfig load the HTTPServer config"), (2, "the of and"), (3, None), (4, "zebra")]
    got = question.compressed(spark.createDataFrame(files, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), 60).orderBy("item_id", "place").collect()
    kept = [(k, t) for k, t in files if k is not None and t is not None]
    for item, text in asked:
        assert [(r.place, r.doc_id, r.tokens, r.excerpt) for r in got if r.item_id == item] == plain_excerpts(set(terms(text)), kept, 60)


def test_whole_files(spark, sf, tables):
    got = defaultdict(list)
    for r in QUERIES["ret11_whole_files"](spark, sf).orderBy("item_id", "place").collect():
        got[r.item_id].append((r.conv_id, r.turn))
    convs = defaultdict(list)
    for c, t, x in sorted(tables["conversations"]):
        convs[c].append((t, x))
    ids = sorted(convs)
    for item, text in tables["benchmark"]:
        scores = bm25(set(terms(text)), ["\n".join(x for _, x in convs[c]) for c in ids])
        left, want = BUDGET, []
        for s, c in sorted(zip(scores, ids, strict=True), reverse=True):
            for t, x in sorted(convs[c], key=lambda r: ("\nstatus: stale" in r[1] or r[1].startswith("status: stale"), r[0])) if s > 0 else []:
                size = max(1, len(x.encode()) // 4)
                if size <= left:
                    left -= size
                    want.append((c, t))
        assert got[item] == want


def concepts(text):
    v = np.zeros(64)
    for t in set(terms(text)[:32]) if isinstance(text, str) else text:
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        v[h % 64] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else v


def dense(rows, budget, criterion):
    """[(key, gain)] by a plain greedy over (key, tokens, tau, vector)."""
    inverse, left, out, rest = np.eye(64) / 1e-2, budget, [], sorted((r for r in rows if r[2] > 0 and r[1] > 0), key=lambda r: r[0])
    while True:
        fit = [(r, math.log1p(r[2] * max(0.0, float(r[3] @ inverse @ r[3])))) for r in rest if r[1] <= left]
        fit = [(round(g / r[1] if criterion == "density" else g, 12), r, g) for r, g in fit if g >= 1e-6]
        if not fit or (criterion == "singleton" and out):
            return out
        _, r, g = max(fit, key=lambda x: x[0])
        out.append((r[0], g))
        rest = [x for x in rest if x[0] != r[0]]
        u = inverse @ r[3]
        inverse = inverse - r[2] / (1 + r[2] * float(r[3] @ u)) * np.outer(u, u)
        left -= r[1]


@pytest.mark.parametrize("keep,block", [(2000, 20_000), (4, 7), (1, 3)])
@pytest.mark.parametrize("criterion", ["density", "gain", "singleton"])
def test_log_det_is_the_dense_greedy(spark, keep, block, criterion):
    """A hot group, groups of one, rows without tau or tokens, equal rows; whatever is kept of a pass."""
    rng = np.random.default_rng(5)
    rows = []
    for g, n in ((0, 60), (1, 1), (2, 9), (3, 0), (4, 3)):
        for k in range(n):
            v = rng.normal(size=64) if g != 4 else np.ones(64)
            rows.append((g, k, int(rng.integers(0, 30)) if g != 4 else 5, float(rng.choice([0.0, 0.1, 1.0, 1.0])) if g != 4 else 1.0, v / np.linalg.norm(v)))
    df = spark.createDataFrame([(g, k, t, w, v.tolist()) for g, k, t, w, v in rows], "g long, k long, tokens long, tau double, vector array<double>")
    got = defaultdict(list)
    for r in question.log_det(df, 100, "g", "k", criterion, keep=keep, block=block).orderBy("g", "place").collect():
        got[r.g].append((r.k, round(r.gain, 8)))
    for g in range(5):
        assert got[g] == [(k, round(x, 8)) for k, x in dense([r[1:] for r in rows if r[0] == g], 100, criterion)]


def test_choice_without_a_question(spark, sf, tables):
    got = defaultdict(list)
    for r in QUERIES["ret12_log_det"](spark, sf).orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.turn, r.criterion))
    by = defaultdict(list)
    for c, t, x in tables["conversations"]:
        by[c].append((t, max(1, len(x.encode()) // 4), 1.0, concepts(x)))
    for c, rows in by.items():
        every = [(n, dense(rows, OPEN_BUDGET, n)) for n in ("density", "gain", "singleton")]
        name, want = max(every, key=lambda x: round(sum(g for _, g in x[1]), 9))
        assert got[c] == [(k, name) for k, _ in want]


def test_choice_without_a_question_reads_whole_texts(spark):
    """Texts with the same first forty terms, which differ behind them: all are chosen, and of two copies only one."""
    head = " ".join(f"head{k}x" for k in range(40))
    tails = [" ".join(f"tail{i}x{k}" for k in range(200)) for i in range(3)]
    texts = [head, *[f"{head} {t}" for t in (tails[0], tails[0], tails[1], tails[2])]]
    df = spark.createDataFrame([(1, k, t, 10) for k, t in enumerate(texts)], "g long, k long, text string, tokens long")
    every = [(n, dense([(k, 10, 1.0, concepts(set(terms(t)))) for k, t in enumerate(texts)], 40, n)) for n in ("density", "gain", "singleton")]
    name, want = max(every, key=lambda x: round(sum(g for _, g in x[1]), 9))
    got = question.without_question(df, 40, "g", "k", "text", "tokens").orderBy("place").collect()
    assert [(r.k, r.criterion) for r in got] == [(k, name) for k, _ in want]
    assert {r.k for r in got} == {0, 1, 3, 4}


def test_concepts_of_nothing(spark):
    assert spark.createDataFrame([([],)], "t array<string>").select(F.aggregate(question.concepts(F.col("t")), F.lit(0.0), lambda a, x: a + F.abs(x)).alias("x")).first().x == 0.0


def test_log_det_hands_on_no_inverse_of_finished_groups(spark, monkeypatch):
    """What a group has left to do is what the passes keep: none of groups that are done, and no broadcast of 32 KB a group."""
    kept = []

    def spy(df, label):
        got = written(df, label)
        kept.append((label, got))
        return got

    written = question.written
    monkeypatch.setattr(question, "written", spy)
    rows = spark.range(200).selectExpr("id % 50 as g", "id as k", "10L as tokens", "1.0D as tau", "transform(sequence(0, 63), i -> IF(i = id % 64, 1.0D, 0.0D)) as vector")
    assert question.log_det(rows, 25, "g", "k").count() == 100
    states = [df for label, df in kept if label in ("question-state", "question-picked")]
    assert len(states) == 2
    assert sum(df.where("_m is not null").count() for df in states) == 0
