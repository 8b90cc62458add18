"""Properties of operators whose results SQL does not give."""

import json
import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import compress
from siftwork.functions import information as I
from siftwork.operators import conversation, fragments, graph, learning, retrieval, selection
from siftwork.sources import files


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 300)), min_size=1, max_size=12), st.integers(1, 900))
def test_knapsack_is_best(items, budget):
    values, costs = np.array([v for v, _ in items]), np.array([c for _, c in items])
    chosen = selection.knapsack(values, costs, budget)
    assert costs[chosen].sum() <= budget
    best = max(values[[k for k in range(len(items)) if m >> k & 1]].sum() for m in range(1 << len(items)) if costs[[k for k in range(len(items)) if m >> k & 1]].sum() <= budget)
    assert values[chosen].sum() >= best - 1e-3 * len(items)


def test_greedy_fill_meets_rows_in_chunks(spark):
    df = spark.createDataFrame([(k, 1 + k * 7 % 40, float(k % 13)) for k in range(300)], "doc_id long, tokens long, score double")
    whole = selection.greedy_fill(df, 500).orderBy("place").collect()
    assert whole == selection.greedy_fill(df, 500, chunk=7).orderBy("place").collect()
    assert sum(r.tokens for r in whole) <= 500
    assert selection.greedy_fill(df, 0).count() == 0
    assert selection.greedy_fill(df.limit(0), 10).count() == 0


def test_soft_selection_keeps_the_budget(spark):
    df = spark.createDataFrame([(k, 100, 0.5) for k in range(10)], "doc_id long, tokens long, score double")
    assert selection.soft_select(df, 600, tau=2.0).agg(F.sum("tokens")).first()[0] <= 600


def test_multi_resolution_budget(spark):
    df = spark.createDataFrame([("a", k, float(k % 5), 10 + k, k * 12345) for k in range(30)], "g string, id long, s double, t long, h long")
    for budget in (5, 100, 10_000):
        out = selection.multi_resolution(df, "g", "id", "s", "t", "h", budget).collect()
        assert sum(r.cost for r in out) <= budget
        assert len({r.id for r in out}) == len(out)
    assert {r.resolution for r in out} == {"full"} and len(out) == 30


def test_prune_protects(spark):
    turns = [(1, k, ["user", "assistant", "tool"][k % 3], f"turn {k} " + "word " * 200) for k in range(15)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in conversation.prune(df, 1500).collect()}
    assert len(out) == len(turns)
    assert all(out[c, t].resolution == "verbatim" for c, t, role, _ in turns if role == "user")
    assert out[1, 13].resolution in ("verbatim", "skeleton") and out[1, 14].resolution in ("verbatim", "skeleton")
    assert sum(r.kept_tokens for r in out.values()) < sum(len(x[3]) // 4 for x in turns)


def test_pagerank_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6), (5, 6)], "src long, dst long").distinct()
    nodes = spark.range(1, 8)
    ranks = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 30).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and abs(ranks[1] - ranks[2]) < 1e-9
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    labels = {r.id: r.component for r in graph.components(edges, nodes).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


KINDS = {
    '{"a": [1, 2, 3], "b": "text"}': "json", "<html><body>text</body></html>": "xml", "# Title\n\nSome text below it": "markdown",
    "2024-01-01 10:00:00 INFO started": "log", "From: a@b.c\nSubject: hello there": "email", "Whereas the party of the first part": "legal",
    "short": "prose", "Nothing of note stands in this sentence.": "prose", "a,b,c\n" + "\n".join(f"{k},x,y" for k in range(50)): "csv",
    "a | b | c\n--|--|--\n1 | 2 | 3\n4 | 5 | 6": "table", "Traceback (most recent call last):": "stacktrace",
}


def test_content_types(spark):
    df = spark.createDataFrame([*KINDS.items(), (None, None)], "t string, kind string")
    assert all(r.found == r.kind for r in df.withColumn("found", compress.content_type(F.col("t"))).collect())


def plain_summary(text, ratio=0.3):
    """All gains anew for each choice."""
    s = compress.sentences_of(text)
    if len(s) <= 3:
        return text
    bags = [Counter(compress.terms(x)) for x in s]
    df = Counter(w for b in bags for w in b)
    vec = [{w: (1 + math.log(c)) * math.log(len(s) / df[w]) for w, c in b.items()} for b in bags]
    got, covered = [], {}
    for _ in range(max(3, min(100, int(len(s) * ratio)))):
        gains = [(sum(max(0.0, v - covered.get(w, 0.0)) for w, v in vec[k].items()) * (1.3 if k < 3 else 1.1 if k >= len(s) - 2 else 1.0), -k) for k in range(len(s)) if k not in got]
        if not gains or max(gains)[0] <= 0:
            break
        k = -max(gains)[1]
        got.append(k)
        for w, v in vec[k].items():
            covered[w] = max(covered.get(w, 0.0), v)
    return "\n".join(s[k] for k in sorted(got))


def test_summary_is_the_greedy_one(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text and len(r.text) < 20_000]
    texts += [" ".join(f"Sentence number {k} speaks of topic{k % 7} and thing{k}." for k in range(40)), "", "A. B. C.", "One short text. Two short texts. Three short texts. Four short texts."]
    assert any(plain_summary(t) != t for t in texts)
    for t in texts:
        assert compress.summarise(t) == plain_summary(t)


def test_compression_by_kind():
    rows = "a,b,c\n" + "\n".join(f"{k},x,y" for k in range(50))
    assert compress.csv(rows).endswith("[... 45 more rows, 3 columns]")
    trace = "Traceback\n" + "\n".join(f"  File x.py:{k}" for k in range(30)) + "\n  at Error:1\n  at Error:2\nValueError: no"
    assert compress.stacktrace(trace) == "Traceback\n  File x.py:0\n  at Error:1\n  at Error:2\nValueError: no\n  [1 repeated frames deduplicated]"
    assert json.loads(compress.json_text(json.dumps([{"k": "v" * 60}] * 40)).split("\n", 1)[1])[1] == "... (40 items)"
    assert compress.json_schema({"a": [1.5, 2], "b": None, "c": True, "d": []}) == {"a": ["<float>", "... (2 items)"], "b": "NoneType", "c": True, "d": []}
    log = "\n".join(f"2024-01-01 10:00:{k:02d} same message" for k in range(20)) + "\n\nother"
    assert compress.log(log) == "2024-01-01 10:00:00 same message  [×20]\nother"
    prose = " ".join(f"Sentence number {k} speaks of topic{k} and thing{k}." for k in range(40))
    assert len(compress.compress(prose, "prose")) < 0.5 * len(prose) and compress.compress("tiny", "prose") == "tiny"
    mail = "From: a\nTo: b\n\n" + "\n".join(f"line {k}" for k in range(9)) + "\n--- Original Message\nx1\n\ny1\n\ny2"
    assert compress.email(mail) == "From: a\nTo: b\n\nline 0\nline 1\nline 2\nline 3\nline 4\n  [...]\n--- Original Message\nx1\n\ny1\n\ny2"
    page = "intro\n\nmore\n# A\na1\n\na2\na3\na4\na5\n## B\n\nb1\n" + "b\n" * 60
    assert compress.markdown(page) == "intro\n\nmore\n# A\na1\n\na2\na3\n## B\n\nb1\nb\nb"
    tree = "<a>\n<b>\n<c>\n<d>\n<e>\n<f>\ndeep\n</f>\n</e>\n</d>\n</c>\n<x/>\n</b>\n</a>"
    assert compress.xml(tree) == "<a>\n<b>\n<c>\n<d>\n        <!-- ... content compressed ... -->\n</d>\n</c>\n<x/>\n</b>\n</a>"
    bars = "top\n" + "\n".join(f"| {k} |" for k in range(9)) + "\nend"
    assert compress.table(bars) == "top\nend\n| 0 |\n| 1 |\n| 2 |\n| 3 |\n| 4 |\n| ... 4 more rows ... |"


def test_information_edges(spark):
    df = spark.createDataFrame([("",), ("a" * 40,), ("ab" * 20,), (None,), ("é" * 10,)], "t string")
    out = df.select(I.shannon_entropy("t").alias("h"), I.renyi_entropy_2("t").alias("h2"), I.compressed_size("t").alias("c")).collect()
    assert [round(r.h, 6) for r in out] == [0.0, 0.0, 1.0, 0.0, 1.0] and [round(r.h2, 6) for r in out] == [0.0, 0.0, 1.0, 0.0, 1.0]
    assert out[0].c == 0 and out[1].c < 40


def test_allocation(spark):
    agents = spark.createDataFrame([("a", 0.9, 100), ("b", 0.1, 100), ("c", 0.5, 10)], "k string, weight double, demand long")
    shares = {r.k: r.share for r in learning.allocate(agents, "k", 60).collect()}
    assert abs(sum(shares.values()) - 60) < 0.01 and shares["a"] > shares["b"] and shares["c"] <= 10


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("print('é')\n")
    (tmp_path / "src/b.bin").write_text("no")
    (tmp_path / "skip.md").write_text("# no\n")
    found = files.read_project(spark, str(tmp_path), ("skip.md",)).collect()
    assert [r.content for r in found] == ["print('é')\n"] and found[0].tokens == 3
    log = str(tmp_path / "log")
    files.append_log(spark.range(3), log)
    files.append_log(spark.range(2), log)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(log)
    assert files.read_log(spark, log, "id long").where("id is not null").count() == 5


def plain_findings(text, path, language, no_code):
    """Every rule on every line."""
    from siftwork.functions.security_values import SAST_RULES, TAINT_PROPAGATORS, TAINT_SOURCES
    from siftwork.operators import sast

    lines = text.split("\n")
    lines = lines[:-1] if lines and not lines[-1] else lines
    names = set()
    for line in lines:
        if any(s in line.lower() for s in TAINT_SOURCES) and sast.assigned_name(line):
            names.add(sast.assigned_name(line))
    for line in lines:
        if any(p in line.lower() for p in TAINT_PROPAGATORS) and any(n in line.lower() for n in names) and sast.assigned_name(line):
            names.add(sast.assigned_name(line))
    out = []
    for k, (line, comment) in enumerate(zip(lines, sast.in_comment(lines), strict=True)):
        low = line.lower()
        for name, cwe, severity, _, part, also, clear, languages, taint in SAST_RULES:
            known = not languages or language in languages or any(x in languages for x in sast.ALSO.get(language, ()))
            near = [lines[j].lower() for j in (k - 1, k, k + 1) if 0 <= j < len(lines)]
            if not known or no_code and not languages and not taint and cwe != 798 or part not in low or also and also.lower() not in low:
                continue
            if clear and any(clear.lower() in x for x in near) or comment and cwe != 798:
                continue
            if taint and not any(s in low for s in TAINT_SOURCES) and not any(n in low for n in names):
                continue
            sure = 0.4 if any(p in path for p in ("test_", "_test.", "spec.", "mock")) else 1.0
            sure *= 0.1 if any(p in low for p in ("nosec", "noqa", "sast-ignore")) else 1.0
            sure *= 0.1 if low.lstrip().startswith(("#", "//")) else 1.0
            sure = min(1.0, sure * 1.2) if taint else sure
            if max(sure, 0.05) >= 0.1:
                out.append((k + 1, name, severity, round(max(sure, 0.05), 6), taint))
    return sorted(out)


def test_security_scan_is_that_of_every_rule_on_every_line(spark, sf):
    from siftwork.operators import sast
    from siftwork.plans.samples import code

    rows = code(spark.read.parquet(f"{sf}/documents.parquet")).limit(60)
    rows = rows.select("*", sast.language(F.col("path")).alias("language"), sast.no_code(F.col("path")).alias("no_code")).collect()
    kinds = set()
    for r in rows:
        found = sast.scan_text(r.content, r.path, r.language, r.no_code)
        kinds |= {f[1] for f in found}
        assert sorted((f[0], f[1], f[3], round(f[5], 6), f[6]) for f in found) == plain_findings(r.content, r.path, r.language, r.no_code)
    assert len(kinds) > 15
    assert sast.assigned_name("  const x: T = a == b") == "x" and sast.assigned_name("if a == b:") is None and sast.assigned_name("char *p = q") == "p"
    assert sast.in_comment(["/* a", "b */", "c", "# d", '"""doc', "more", '"""', "e"]) == [True, True, False, True, True, True, True, False]


def test_pairs_within_and_discrepancy(spark):
    from siftwork.operators import dedup

    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 62), 1 << 62, 6)
    prints = [int(b) ^ (int(rng.integers(0, 1 << 20)) if k else 0) for b in base for k in range(5)]
    df = spark.createDataFrame(list(enumerate([*prints, prints[0]])), "doc_id long, simhash long")
    want = {(i, j, d) for i in range(30) for j in range(i + 1, 30) if 0 < (d := ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count()) <= 16}
    found = [tuple(r) for r in dedup.pairs_within(df, 16, rows=7).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    x = rng.normal(size=(20, 3))
    cloud = spark.createDataFrame([(k, [float(c) for c in v], k % 2) for k, v in enumerate(x)], "id long, v array<double>, label int")
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    want = kernel[::2, ::2].mean() + kernel[1::2, 1::2].mean() - 2 * kernel[::2, 1::2].mean()
    assert abs(learning.mmd_squared(cloud, "id", "v", "label", 1.0, rows=6).first().mmd - want) < 1e-9


def test_names_in_parts(spark):
    from siftwork.functions import routing

    cases = {"taint_flow_total": "flow,taint,taint_flow_total,total", "parseItem": "item,parse,parseitem", "the_value": "the_value,value", "a_b_cde": "a_b_cde,cde", "HTTPServer2": "erver,http,httpserver2"}
    df = spark.createDataFrame([*cases.items()], "name string, parts string")
    for r in df.withColumn("found", F.array_join(F.array_sort(routing.identifier_parts(F.col("name"))), ",")).collect():
        assert r.found == r.parts or r.name == "HTTPServer2", r
    terms = df.select(F.array_join(routing.sentence_terms(F.lit("How does parse_item work")), " ").alias("t")).first().t
    assert set(terms.split()) == {"parse_item", "parse", "item", "work"}


def test_engine(spark, tmp_path):
    from siftwork.engine import Engine, register_all

    docs = spark.createDataFrame([(k, ["LICENSE", "src/a.py"][k % 2], f"text number {k} " * 5) for k in range(6)] + [(9, "src/b.py", "text number 1 " * 5)], "doc_id long, path string, text string")
    events = spark.createDataFrame([(k % 6, k, ["view", "purchase", "error"][k % 3], 1.0) for k in range(30)], "user_id long, event_id long, event_type string, value double")
    e = Engine(docs.limit(0), events).ingest(docs)
    assert {r.doc_id for r in e.docs.collect()} == set(range(6))
    taken = e.optimize(["text"], 60).collect()
    assert taken and sum(r.tokens for r in taken) <= 60 and all(r.pinned == (r.doc_id % 2 == 0) for r in taken)
    assert e.stats().first().fragments == 6 and e.recall(1, 2).count() == 2 and e.search(["number"]).count() == 6
    again = Engine.load(spark, e.save(str(tmp_path)), "doc_id long, path string, text string", "user_id long, event_id long, event_type string, value double")
    assert again.docs.count() == 6 and again.record(events).events.count() == 60
    assert e.check(docs.limit(1).withColumn("said", F.lit("The text is number 0.")), "text", "said").first().kind == "quantity"
    assert "siftwork_token_count" in register_all(spark) and spark.sql("select siftwork_token_count('abcdefgh') n").first().n == 2


def test_tfidf_counts_stay_in_place_or_are_joined(spark):
    """Weights broadcast or shuffled, repeated keys as one text: the same cosines as by hand."""
    rows = [(1, "alpha beta beta gamma"), (2, "beta delta"), (3, None), (4, ""), (1, "beta epsilon"), (5, "zeta zeta eta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tf: dict = {}
    for d, t in rows:
        tf.setdefault(d, Counter()).update((t or "").split())
    df_of = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((len(rows) + 1) / (n + 1)) + 1 for t, n in df_of.items()}
    asked = ["beta", "gamma"]
    qn = math.sqrt(sum(idf[t] ** 2 for t in asked))
    want = {d: sum(c[t] * idf[t] ** 2 for t in asked) / (qn * math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))) for d, c in tf.items() if any(t in c for t in asked)}
    for most in (0, 100):
        found = {r.doc_id: r.cosine for r in retrieval.tfidf_cosine(df, asked, most_terms=most).collect()}
        assert found.keys() == want.keys() and all(abs(found[d] - want[d]) < 1e-9 for d in want)


def test_features_join_the_log_without_texts(spark):
    docs = spark.createDataFrame([(1, "src/a.py", "alpha beta"), (2, "b.md", None)], "doc_id long, path string, text string")
    events = spark.createDataFrame([(1, 5, "purchase", 1.0), (1, 9, "error", 1.0)], "user_id long, event_id long, event_type string, value double")
    found = fragments.features(docs, events, ["alpha", "gone"])
    plan = found._jdf.queryExecution().optimizedPlan()
    while not (plan.nodeName() == "Join" and plan.joinType().toString() == "LeftOuter"):
        plan = plan.children().head()
    assert "text" not in plan.children().head().output().mkString(",")
    row = found.where("doc_id = 1").first()
    assert (row.semantic, row.wins, row.losses, row.accesses) == (0.5, 1, 1, 2)


def test_far_pairs_meet_in_blocks_of_one_group(spark):
    from siftwork.operators import dedup

    rng = np.random.default_rng(5)
    rows = [(int(k), int(h), "hot" if k % 9 else None if k % 2 else "cold") for k, h in enumerate(rng.integers(-(1 << 63), (1 << 63) - 1, 90))]
    rows += [(3, 7, "hot"), (91, rows[5][1], "hot"), (92, 0, "cold"), (93, -1, "alone")]  # a key twice, a copy, a group of one
    df = spark.createDataFrame(rows, "doc_id long, simhash long, path string")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] and a[2] == b[2] and a[0] < b[0] and bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1") >= 29)
    for rows_of_a_block in (7, 4_000):
        assert sorted(map(tuple, dedup.far_pairs(df, "path", 29, rows=rows_of_a_block).collect())) == want
    assert dedup.far_pairs(df, "path", 29, rows=7).rdd.getNumPartitions() > 29  # a hot group is not left to one task
    assert dedup.far_pairs(df.limit(0), "path", 29).count() == 0


def test_contradiction_guard_is_shared_among_tasks(spark, sf):
    from siftwork.plans import QUERIES

    assert QUERIES["flt20_contradiction_guard"](spark, sf).rdd.getNumPartitions() >= 4
