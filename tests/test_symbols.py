"""The model of characters and the verifier of names, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.functions import grams
from siftwork.functions.code_refs import references
from siftwork.operators import symbols


def plain_model(texts, n):
    """Counts of runs by order, of their contexts, and of all characters."""
    counts, contexts = Counter(), Counter()
    for t in texts:
        padded = symbols.START * (n - 1) + t + symbols.END if t else ""
        for i in range(n - 1, len(padded)):
            for k in range(1, n + 1):
                counts[padded[i - k + 1 : i + 1]] += 1
                contexts[k, padded[i - k + 1 : i]] += 1
    return counts, contexts


def plain_surprisal(name, model, n):
    counts, contexts = model
    padded, total = symbols.START * (n - 1) + name, 0.0
    for i in range(n - 1, len(padded)):
        for k in range(n, 0, -1):
            g = padded[i - k + 1 : i + 1]
            if counts[g]:
                total += math.log(counts[g] / contexts[k, g[:-1]]) + (n - k) * math.log(0.4)
                break
        else:
            total += -10.0
    return -total / max(1, len(name))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\x00\x02é🎉"), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 5))
def test_counted_runs(texts, n):
    got = dict(zip(*grams.counted(texts, n, symbols.START, symbols.END), strict=True))
    counts, _ = plain_model(texts, n)
    want = Counter()
    for t in texts:
        padded = symbols.START * (n - 1) + t + symbols.END
        want.update(padded[i - n + 1 : i + 1] for i in range(n - 1, len(padded)))
    assert got == want and sum(got.values()) == sum(len(t) + 1 for t in texts)


def test_counted_runs_of_many_characters():
    """More different characters than a number to their base can hold."""
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(3000)) for _ in range(3)]
    got = dict(zip(*grams.counted(texts, 5, symbols.START, symbols.END), strict=True))
    want = Counter()
    for t in texts:
        padded = symbols.START * 4 + t + symbols.END
        want.update(padded[i - 4 : i + 1] for i in range(4, len(padded)))
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 4])
def test_surprisal(spark, monkeypatch, n):
    monkeypatch.setattr(grams, "CHUNK", 40)
    rng = random.Random(n)
    texts = ["".join(rng.choice(["get_", "load", "Config", "é", "🎉", " ", "set_"]) for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["", "a"]
    names = ["get_config", "loadConfig", "zzz", "", "é🎉", "get_get_", "Q", "load"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    model = symbols.train(df, "t", n)
    plain = plain_model(texts, n)
    assert {(r.gram, r.order): (r.n, r.of) for r in model.collect()} == {(g, len(g)): (c, plain[1][len(g), g[:-1]]) for g, c in plain[0].items()}
    got = symbols.surprisal(spark.createDataFrame([(x,) for x in [*names, None, "load"]], "name string"), "name", model, n)
    assert {r.name: round(r.surprisal, 8) for r in got.collect()} == {x: round(plain_surprisal(x, plain, n) + 0.0, 8) for x in names}


def test_references_of_odd_sources():
    assert references("") == [] and references("x = 1\n") == []
    assert sorted(references("a.b.c(d)[0].e(f(g))")) == sorted([("e", "call", 1), ("e", "attribute", 1), ("c", "call", 1), ("c", "attribute", 1), ("b", "attribute", 1), ("f", "call", 1)])
    assert sorted(references("@x.y(1)\nasync def f(a: list[int], *b: c) -> 'late':\n  import q.r as s, t\n  from . import u\n  from v import *\n")) == sorted(
        [("y", "decorator", 1), ("y", "call", 1), ("y", "attribute", 1), ("list", "annotation", 2), ("q", "import", 3), ("t", "import", 3), ("u", "import", 4), ("v", "import", 5)]
    )
    assert references("def (\n call(x) if(y)\x00") == [("call", "call", 2)]  # no keyword, and the name that def lacks


def test_verify(spark):
    """Names that are there, that are not, that always are; sources without references; a product over many references."""
    sources = [(1, "get_config(self.__dict__)\nx.load()"), (2, "nowhere()"), (3, "y = 1"), (4, None), (5, "load(); " * 40), (6, "main(); a()")]
    manifest = ["get_config", "load", "a"]
    texts = ["get_config load set_config", "load_all get_all"]
    model = symbols.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    refs = symbols.refs(spark.createDataFrame(sources, "id long, source string"), "id", "source")
    verdicts, scores = symbols.verify(refs, spark.createDataFrame([(m,) for m in manifest], "name string"), model, "id")
    plain, want = plain_model(texts, 4), defaultdict(lambda: [0.0, 0, 0, 0])
    for i, source in sources:
        for name, _, _ in references(source or ""):
            always = name in symbols.GROUND or (name.startswith("__") and name.endswith("__"))
            s = plain_surprisal(name, plain, 4)
            p = 0.0 if always or len(name) <= 1 else 1.0 if name not in manifest else 1 / (1 + math.exp(-(s - 6.5)))
            w = want[i]
            w[0] += math.log(1 - min(p, 1 - 1e-12))
            w[1] += always or name in manifest
            w[2] += not (always or name in manifest)
            w[3] += (always or name in manifest) and p > 0.5
    got = {r.id: (round(r.h, 8), r.resolved, r.unresolved, r.suspicious) for r in scores.collect()}
    assert got == {i: (round(1 - math.exp(w[0]), 8), *w[1:]) for i, w in want.items()}
    assert 3 not in got and got[2][0] > 0.999
    assert verdicts.count() == sum(len(references(s or "")) for _, s in sources)


def test_sources_of_one_shape_are_parsed_once(spark, monkeypatch):
    """References are those of every source parsed on its own, whatever was remembered; odd sources are never of a shape."""
    import pyarrow as pa

    from siftwork.functions import code_refs

    odd = [None, "", "x = 'f(a)'", 'f"{g(1)!r}"', "é(1)", "a(\\\n1)", "match(x)", "type(y)", "match x:\n case 1: f()\n", "f(_)", "def f(a): g(01)", "def f(a): g(10)", "0x1f(a)", "1if a else b(1)", "a.b.a(a, b)", "a.b.c(a, b)", "a.b.a(b, a)", "f(if)", "f(a\x00)", "__debug__(a)", "x__debug__(1)", "f(1.5)", "f(1_0)", "f(1e5)", "f(1 .real)", "# f(a)\n", "True(a)", "None.b", "self.x", "print (x)", "print x(1)"]
    made = [f"class Big{i}(Base{i % 7}):\n    async def run(self, a=make{i % 5}()):\n        self.x.attr{i}({i})\n" for i in range(1, 301)]
    called = []

    def counting(source):
        called.append(source)
        return references(source)

    monkeypatch.setattr(code_refs, "references", counting)
    texts = odd * 2 + made
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    got = [r for b in code_refs.ref_batches(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert got == [(i, *r) for i, t in enumerate(texts) for r in references(t or "")]
    assert sum(s.startswith("class Big") for s in called) == 1


def test_surprisal_broadcasts_no_runs(spark):
    """Names are small before they are cut to runs; what they are cut to is no table to broadcast."""
    model = symbols.train(spark.createDataFrame([("get load set",)], "t string"), "t")
    model = spark.createDataFrame(model.collect(), model.schema)  # its own joins don't matter here
    got = symbols.surprisal(spark.range(2000).selectExpr("concat('load', id) as name"), "name", model)
    assert len(got.collect()) == 2000
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
