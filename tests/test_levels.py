"""Context in three levels against plain Python: generated projects, and every order of the small tables."""

import hashlib
import random
from collections import defaultdict

import pytest

from siftwork.operators import levels
from siftwork.plans import QUERIES
from siftwork.plans.levels import BUDGET, files, links, relevant


def one_liner(skeleton):
    names = []
    for line in (skeleton or "").split("\n"):
        x = line.strip()
        words = x.split()
        if x.startswith(("def ", "async def ")):
            while x.startswith("async "):
                x = x[6:]
            while x.startswith("def "):
                x = x[4:]
            name = x.split("(")[0].strip()
            name = "" if name.startswith("_") else name
        elif x.startswith("class "):
            name = x[6:].split("(")[0].split(":")[0].strip()
        elif x.startswith(("fn ", "pub fn ")):
            at = 2 if words[0] == "pub" else 1
            name = words[at].split("(")[0].split("<")[0] if len(words) > at else ""
        elif x.startswith(tuple(p + k for p in ("", "pub ") for k in ("struct ", "enum ", "trait "))):
            at = 2 if words[0] == "pub" else 1
            name = words[at].rstrip("{<:") if len(words) > at else ""
        elif "function " in x and "function" in words and words.index("function") + 1 < len(words):
            name = words[words.index("function") + 1].split("(")[0]
        else:
            name = ""
        names += [name] if name else []
    return ", ".join(names) if len(names) <= 6 else ", ".join(names[:5]) + f", +{len(names) - 5} more"


def shortened(text, size, budget):
    """text cut to its budget at the end of a line, if its size is over it."""
    data = text.encode()
    if size > budget and len(data) > budget * 4:
        text = data[: budget * 4].decode(errors="ignore")
        text = text[: text.rindex("\n")] if "\n" in text else text
    return text


def plain(rows, asked, edges, total):
    """(level1, level2, used1, used2, used3, members, chosen) of one project: rows (key, source, skeleton, tokens, entropy), asked keys in order."""
    b1 = int(min(500.0, max(50.0, total * 0.05)))
    mean = sum(r[4] for r in rows) / len(rows)
    b2 = int((total - b1) * (0.20 if mean > 0.7 else 0.35 if mean < 0.3 else 0.25))
    b3 = total - b1 - b2
    rows = sorted(rows)
    one = "\n".join(s + (f" → {one_liner(k)}" if one_liner(k) else "") for _, s, k, _, _ in rows)
    size1 = max(1, len(one.encode()) // 4)
    by, depth, edge = {r[0]: r for r in rows}, dict.fromkeys(asked, 0), {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    for d in (1, 2):
        for a, b in edge:
            if depth.get(a) == d - 1 and b not in depth:
                depth[b] = d
    members = {k: d for k, d in depth.items() if k in by}
    inner = [r for r in rows if r[0] in members and r[2] is not None]
    two = "\n".join(f"## {s}\n{k}\n" for _, s, k, _, _ in inner)
    size2 = sum(max(1, len(k.encode()) // 4) for _, _, k, _, _ in inner)
    used1, used2 = min(size1, b1), min(size2, b2)
    room, used, counts, chosen = b3 + b1 - used1 + b2 - used2, 0, defaultdict(int), []
    order = [(k, 1.0 - min(0.8, i * 0.05)) for i, k in enumerate(asked) if k in by] + [(k, 0.3) for k, d in sorted(members.items(), key=lambda x: (x[1], x[0])) if k not in asked]
    for k, base in order:
        module = by[k][1].removeprefix("file:").rpartition("/")[0]
        if base / (1.0 + counts[module]) > 0.1 and used + by[k][3] <= room:
            chosen.append(k)
            counts[module] += 1
            used += by[k][3]
    return shortened(one, size1, b1), shortened(two, max(1, len(two.encode()) // 4), b2), used1, used2, used, len(members), chosen


def same(spark, projects, total):
    """projects {g: (rows, asked, edges)}; compress() of all of them at once against plain()."""
    f = spark.createDataFrame([(g, *r) for g, (rows, _, _) in projects.items() for r in rows], "g long, k long, source string, skeleton string, tokens long, entropy double")
    asked = spark.createDataFrame([(g, k, i) for g, (_, a, _) in projects.items() for i, k in enumerate(a)], "g long, k long, rank int")
    edges = spark.createDataFrame([(g, a, b) for g, (_, _, e) in projects.items() for a, b in e], "g long, src long, dst long")
    packs, chosen = levels.compress(f, asked, edges, total, "g", "k")
    picked = defaultdict(list)
    for r in chosen.orderBy("g", "place").collect():
        picked[r.g].append(r.k)
    got = {r.g: (r.level1, r.level2, r.used1, r.used2, r.used3, r.members, picked[r.g]) for r in packs.collect()}
    assert got == {g: plain(*p, total) for g, p in projects.items()}
    assert all(x[2] + x[3] + x[4] <= total for x in got.values())


SKELETONS = [None, "", "class A(B):\n  def run(self):\n  def _p(self):", "pub fn go<T>(x)\npub struct Großes{\n", "function draw(a)\nexport function  x (b)", "\n".join(f"def f{k}():" for k in range(9)), "fn", "pub", "a function of time\nfunction"]


@pytest.mark.parametrize("total", [200, 1500, 20_000])
def test_generated_projects(spark, total):
    """Projects of one file and of many, cycles, edges to nowhere, relevant files that are not there, texts that are cut within a character."""
    rng, projects = random.Random(total), {}
    for g in range(10):
        n = rng.choice([1, 3, 20, 60])
        rows = [(k, f"file:{rng.choice(['src/a', 'src/ü', 'lib'])}/größe{k}.py" if k % 5 else f"top{k}.py", rng.choice(SKELETONS), rng.choice([5, 60, 300]), round(rng.random(), 2) * (0.2 if g == 1 else 1)) for k in range(n)]
        asked = [] if g == 2 else rng.sample(range(n + 1), min(n, rng.randint(1, 25)))
        projects[g] = (rows, asked, [(rng.randrange(n + 2), rng.randrange(n)) for _ in range(n)])
    same(spark, projects, total)


def test_orders(spark, sf):
    f = files(spark, sf)
    projects = defaultdict(lambda: ([], [], []))
    for r in f.collect():
        projects[r.l_orderkey][0].append((r.file, r.source, r.skeleton, r.tokens, r.entropy))
    for r in relevant(f).orderBy("rank").collect():
        projects[r.l_orderkey][1].append(r.file)
    for r in links(f).collect():
        projects[r.l_orderkey][2].append((r.src, r.dst))
    want = {g: plain(*p, BUDGET) for g, p in projects.items()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = QUERIES["sel26_hierarchical"](spark, sf).collect()
    assert {r.l_orderkey: (r.level1, r.level2, r.used1, r.used2, r.used3, r.members, r.whole) for r in rows} == {g: (md5(w[0]), md5(w[1]), *w[2:6], len(w[6])) for g, w in want.items()}
    picked = defaultdict(list)
    for r in QUERIES["sel12_level3"](spark, sf).orderBy("l_orderkey", "place").collect():
        picked[r.l_orderkey].append(r.file)
    assert {g: picked[g] for g in want} == {g: w[6] for g, w in want.items()}
    for r in QUERIES["conv35_hierarchical_context"](spark, sf).collect():
        one, two, *_, members, chosen = want[r.l_orderkey]
        by = {x[0]: x for x in projects[r.l_orderkey][0]}
        parts = ["--- Relevant Code Context ---\n", f"## Codebase Overview ({len(by)} files)\n```\n{one.rstrip(' ')}\n```\n"]
        parts += [f"## Related Code Structure ({members} connected files)\n{two.rstrip()}\n"] if two else []
        bodies = [f"### {by[k][1]} ({by[k][3]} tokens)\n```\n" + "\n".join(x for x in by[k][1:3] if x is not None).rstrip(" ") + "\n```\n" for k in chosen]
        parts += [f"## Full Code ({len(chosen)} fragments)\n" + "\n".join(bodies)] if chosen else []
        text = "\n".join([*parts, "--- End Context ---"])
        assert (r.context, r.size) == (md5(text), len(text))
