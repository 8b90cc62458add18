"""Values at which SQL's and Spark's own functions part, and texts longer than those of the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwork.functions import routing
from siftwork.functions.text import folded
from siftwork.plans import ORACLES, QUERIES
from siftwork.plans.registry import rounded


def test_patterns_are_read_as_re2_reads_them(spark):
    texts = ["testü", "ütest", "teſt", "booK", "write a\rtest", "write a\ntest", "fix\x0bbug", "end\n", "end", "TEST", "contest", "test_1", None]
    for pattern in (r"\b(test|spec)\b", "book", r"write.*test", r"fix\s?bug", r"fix[\s]bug", "end$", r"\btest\w*"):
        got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.col("t").rlike(folded(pattern))).collect()]
        assert got == [duckdb.execute("SELECT regexp_matches(?::VARCHAR, ?, 'i')", [t, pattern]).fetchone()[0] for t in texts], pattern


def test_prompts_beside_letters_that_are_no_ascii(spark):
    df = spark.createDataFrame([("Add that. einöü testü stiege",)], "q string")
    assert df.select(routing.archetype(F.col("q")), routing.task_profile(F.lit("ein testü"))).first()[:] == ("test/write", "Testing")


def test_rounded_as_duckdb(spark):
    xs = [round(k / n, 6) * f for n in range(1, 60) for k in range(n) for f in (1.0, 1.5, 2.0, 3.0)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(rounded(F.col("x"), 6)).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(x, 6)::DOUBLE FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]


def test_trigrams_of_long_texts(spark, tmp_path):
    """A sum past 2^63 wraps; what fits is the plain sum."""
    texts = [None, "", "ab", "abc", "ÿÿ€" * 7, "zyx " * 30_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["str16_trigram_hashes"](spark, str(tmp_path)).collect():
        b = (texts[r.doc_id] or "").encode()
        total = sum((b[i] * 1099511628211) ^ (b[i + 1] * 16777619) ^ b[i + 2] for i in range(len(b) - 2))
        assert (r.n, r.total) == (max(len(b) - 2, 0), (total + 2**63) % 2**64 - 2**63)


def test_shares_of_ngrams_in_packed_rows(spark, monkeypatch):
    """Shares against plain sets, with copies in one pack and in several; no row for an n-gram is shuffled."""
    import random

    from siftwork.operators import dedup

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "a", "zz yy xx ww vv", "zz yy xx ww vv", "uu tt ss rr uu tt ss rr"]
    sets = {n: [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in ((t or "").split() for t in texts)] for n in (2, 3, 4)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for held in (dedup.HELD, 40):
        monkeypatch.setattr(dedup, "HELD", held)
        found = dedup.gram_shares(df)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        for r in found.collect():
            for n, each in sets.items():
                mine, others = each[r.doc_id], set().union(*(s for i, s in enumerate(each) if i != r.doc_id))
                assert r[f"s{n}"] is None if not mine else abs(r[f"s{n}"] - len(mine & others) / len(mine)) < 1e-12


def test_ngrams_are_shuffled_small(spark):
    """The n-grams that start at a word take under 18 bytes together, texts are scanned once, and the tasks behind do not grow with the session's setting."""
    import random

    from siftwork.operators import dedup

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = dedup.gram_shares(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and f", {dedup.GRAM_TASKS})" in plan
    packed = df.mapInArrow(dedup._gram_buckets((2, 3, 4)), "bucket int, batch bigint, data binary, keys array<bigint>, words array<bigint>, t2 array<bigint>, t3 array<bigint>, t4 array<bigint>")
    assert packed.agg(F.sum(F.octet_length("data"))).first()[0] < 18 * 100 * 399


def test_ngrams_of_more_texts_than_a_batch_has(spark):
    """Numbers of texts in a batch have 16 bits; one of them is the mark of several texts."""
    from siftwork.operators import dedup

    n = 140_000
    df = spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.format_string("w%d x", F.col("id") % 131_072).alias("text"))
    found = dedup.gram_shares(df).groupBy("s2").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).orderBy("s2").collect()
    twice = n - 131_072
    assert [tuple(r) for r in found] == [(0.0, n - 2 * twice, twice), (1.0, 2 * twice, 0)]


def test_state_on_disk_is_not_preallocated():
    """RocksDB sets aside 4 MB for each store's list of files, whatever the store holds."""
    from siftwork.llm import exact_dedup

    assert exact_dedup.STATE["spark.sql.streaming.stateStore.rocksdb.allowFAllocate"] == "false"


def test_blocks_of_pairs_meet_once(spark, monkeypatch):
    """Pairs over many blocks against all pairs, copies and ends of the range of longs included; no pair of blocks is held twice."""
    import random

    from siftwork.operators import dedup, fragments

    rng = random.Random(3)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(60)] + [-(2**63), 2**63 - 1, 0]
    prints += [p ^ (1 << rng.randrange(63)) for p in prints] + prints[:9]
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    want = sorted((min(i, j), max(i, j), far(p, q)) for p, i in first.items() for q, j in first.items() if p < q and far(p, q) <= 20)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, simhash long")
    met = []
    blocked = fragments.blocked
    monkeypatch.setattr(fragments, "blocked", lambda *a: met.extend(blocked(*a)) or met)
    found = dedup.pairs_within(df, 20, rows=10)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "i" in met[0].columns and found._jdf.queryExecution().optimizedPlan().toString().count("Filter (") >= 2


def test_queries_bound_their_batches_by_bytes(spark, sf):
    """Long texts must not pile up in a Python worker: ten thousand rows may be any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        QUERIES["conv9_skeletonize"](spark, sf)
        assert 0 < int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def test_risk_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    """0.3 + 0.4 + 0.2 + 0.1 is less than 1 in this order, not in others; the mean is 0.25 in all."""
    taxes = [(0.03, 0.04, 0.02, 0.01), (0.01, 0.02, 0.03, 0.04), (0.04, 0.03, 0.02, 0.01), (0.02, 0.02, 0.02, 0.03), (0.03, 0.03, 0.02, 0.02001)]
    spark.createDataFrame([(o, 0.05, t) for o, ts in enumerate(taxes) for t in ts], "l_orderkey long, l_discount double, l_tax double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = dict(tuple(r) for r in QUERIES["ret25_build_provenance"](spark, str(tmp_path)).collect())
    assert got == {0: "low", 1: "low", 2: "low", 3: "medium", 4: "low"}


@pytest.mark.parametrize("name", ["stm3_drain", "stm8_enqueue", "stm4_priority"])
def test_priorities_of_empty_texts_and_of_no_source(spark, tmp_path, name):
    """Documents without characters, of unknown size, without a source, and a source with nothing in it, as DuckDB ranks them."""
    texts = [" ".join(f"w{k * j % 17}" for j in range(k % 23 + 2)) for k in range(120)]
    rows = [(k, None if k % 11 == 5 else "" if k % 13 == 4 or k % 5 == 3 else t, None if k % 7 == 2 else f"src{k % 5}") for k, t in enumerate(texts)]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t, s, None if t is None else len(t)) for k, t, s in rows], "doc_id long, text string, source string, n_chars long").write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want, got = con.execute(ORACLES[name]).fetchall(), [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert name == "stm8_enqueue" or "nan" in str(want)
