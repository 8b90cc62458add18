"""The jobs: against their SQL, over growing input, run again, and by their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import context_packs, refresh_index
from jobs.common import defaults
from siftwork.streaming.watch import BATCH

from .test_queries import duck, rows  # noqa: F401

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("job", [refresh_index, context_packs])
def test_query(spark, sf, duck, job):  # noqa: F811
    found, want = job.query(spark, sf).toPandas(), duck.execute(job.SQL).df()
    assert sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


def put(spark, where, part, rows_, schema="doc_id long, text string, source string, lang string, op string"):
    """One more file of a feed."""
    spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(where))


def index_of(df):
    return sorted((r.doc_id, r.digest, r.source) for r in df.collect())


def test_refresh_takes_only_what_is_new(spark, tmp_path, monkeypatch):
    """Two runs over growing input, with rows changed, deleted and come back; then a run that is repeated."""
    import hashlib

    feed, md5 = tmp_path / "feed", lambda t: hashlib.md5((t or "").encode()).hexdigest()
    config = defaults("refresh_index") | {"source": str(feed), "out": f"{tmp_path}/out", "deleted": "op = 'delete'", "buckets": 4}
    put(spark, feed, 0, [(1, "one", "a", "en", None), (2, "two", "a", "en", None), (3, None, "b", "de", None)])
    assert index_of(refresh_index.refresh(spark, config)) == [(1, md5("one"), "a"), (2, md5("two"), "a"), (3, md5(""), "b")]

    read = []
    real = refresh_index.Watch._take
    monkeypatch.setattr(refresh_index.Watch, "_take", lambda self, df, n: (read.append((n, df.count())), real(self, df, n))[1])
    put(spark, feed, 1, [(2, "two!", "a", "en", None), (4, "four", "c", "fr", None), (1, None, None, None, "delete")])
    now = [(2, md5("two!"), "a"), (3, md5(""), "b"), (4, md5("four"), "c")]
    assert index_of(refresh_index.refresh(spark, config)) == now
    assert read == [(1, 3)]  # the second run met the new file's three rows and no others
    assert index_of(refresh_index.refresh(spark, config)) == now and len(read) == 1

    put(spark, feed, 2, [(1, "back", "a", "en", None)])
    now = [(1, md5("back"), "a"), *now]
    assert index_of(refresh_index.refresh(spark, config)) == now
    w = refresh_index.watch(spark, config)
    assert index_of(w.snapshot(0)) == [(1, md5("one"), "a"), (2, md5("two"), "a"), (3, md5(""), "b")]
    assert index_of(w.snapshot(2)) == now
    # all at once, into another folder, gives the same index
    assert index_of(refresh_index.refresh(spark, config | {"out": f"{tmp_path}/other"})) == now


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    """A failure after the writes: the stream does not know that the batch is done, and runs it again."""
    feed = tmp_path / "feed"
    config = defaults("refresh_index") | {"source": str(feed), "out": f"{tmp_path}/out", "buckets": 4}
    put(spark, feed, 0, [(k, f"text {k}", "a", "en", None) for k in range(20)])
    refresh_index.refresh(spark, config)
    put(spark, feed, 1, [(k, f"newer {k}", "a", "en", None) for k in range(10, 30)])
    before = index_of(refresh_index.refresh(spark, config))
    for f in Path(f"{tmp_path}/out/checkpoint/commits").iterdir():
        if f.name.strip(".").split(".")[0] == "1":
            f.unlink()
    assert index_of(refresh_index.refresh(spark, config)) == before
    changes = refresh_index.watch(spark, config).changes()
    assert changes.count() == 40 and changes.groupBy(BATCH).count().count() == 2


def test_a_refresh_over_nothing(spark, tmp_path):
    feed = tmp_path / "feed"
    put(spark, feed, 0, [])
    config = defaults("refresh_index") | {"source": str(feed), "out": f"{tmp_path}/out"}
    assert refresh_index.refresh(spark, config).collect() == []


def plain_packs(docs, packs, budget):
    for item in {r.item_id for r in packs}:
        mine = sorted((r for r in packs if r.item_id == item), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine[-1].used == sum(r.tokens for r in mine) <= budget
        assert [(-r.score, r.doc_id) for r in mine] == sorted((-r.score, r.doc_id) for r in mine)
        assert all(r.text == docs[r.doc_id] for r in mine)


def test_packs_again_and_with_edges(spark, tmp_path):
    """Copies, nulls, ties and questions without a match; a second run, with another budget, replaces the first."""
    rows_ = [(1, "alpha beta gamma", "a"), (2, "alpha  beta gamma", "a"), (3, "alpha delta", "b"), (4, None, "b"), (None, "alpha", "b"), (5, "", "c"), (6, "delta alpha", "c"), (7, "omega " * 300, "c")]
    spark.createDataFrame(rows_, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, "alpha delta"), (2, "nothing here"), (3, None), (4, "omega beta"), (None, "beta")], "item_id long, text string").write.parquet(f"{tmp_path}/questions")
    config = defaults("context_packs") | {"source": f"{tmp_path}/docs", "questions": f"{tmp_path}/questions", "out": f"{tmp_path}/out"}
    docs = {i: t for i, t, _ in rows_}
    found = context_packs.build_packs(spark, config).collect()
    plain_packs(docs, found, 4000)
    assert sorted((r.item_id or 0, r["place"], r.doc_id) for r in found) == [(0, 1, 1), (1, 1, 3), (1, 2, 6), (1, 3, 1), (4, 1, 7), (4, 2, 1)]
    again = context_packs.build_packs(spark, config).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    small = context_packs.build_packs(spark, config | {"budget": 6}).collect()
    assert sorted((r.item_id or 0, r["place"], r.doc_id) for r in small) == [(0, 1, 1), (1, 1, 3), (1, 2, 6), (4, 1, 1)]  # what does not fit is passed over


def test_command_lines(tmp_path, sf):
    """Both jobs as a user starts them: config file, arguments, log."""
    config = {"source": f"{sf}/documents.parquet", "out": f"{tmp_path}/index"}
    (tmp_path / "c.json").write_text(json.dumps(config))
    env = dict(os.environ, PYTHONPATH=str(ROOT), PYSPARK_SUBMIT_ARGS="--master local[4] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell")
    one = subprocess.run([sys.executable, "-m", "jobs.refresh_index", "--config", f"{tmp_path}/c.json", "--buckets", "2"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=180)
    assert one.returncode == 0 and "new since the last run" in one.stderr, one.stderr[-2000:]
    assert duckdb.sql(f"SELECT count(*), count(DISTINCT _bucket) FROM read_parquet('{tmp_path}/index/index/*/*.parquet', hive_partitioning = true)").fetchall()[0] == (duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0], 2)
    bad = subprocess.run([sys.executable, "-m", "jobs.context_packs", "--out", f"{tmp_path}/packs"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=60)
    assert bad.returncode == 2 and "source" in bad.stderr


def test_dependents_of_rows_that_changed(spark):
    from siftwork.streaming.watch import standing

    notes = spark.createDataFrame([("n1", 1, "x"), ("n2", 2, "x"), ("n3", 3, "x"), ("n4", 4, None), ("n5", None, "x")], "note string, doc_id long, seen string")
    index = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "doc_id long, digest string")
    assert {r.note: r.standing for r in standing(notes, index, "doc_id", "seen", "digest").collect()} == {"n1": "fresh", "n2": "stale", "n3": "orphaned", "n4": "fresh", "n5": "orphaned"}


def test_scan_of_files_edited_in_place(spark, tmp_path):
    from siftwork.streaming.watch import scan

    for name, body in (("a.py", "x"), ("b/c.py", "y"), ("d.md", "z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    first, changes = scan(spark, str(tmp_path))
    assert {r.change for r in changes.collect()} == {"added"} and changes.count() == 3
    known = spark.createDataFrame(first.collect(), first.schema)
    (tmp_path / "a.py").write_text("longer")
    (tmp_path / "d.md").unlink()
    (tmp_path / "e.py").write_text("new")
    _, changes = scan(spark, str(tmp_path), known)
    assert {os.path.basename(r.path): r.change for r in changes.collect()} == {"a.py": "changed", "d.md": "deleted", "e.py": "added"}
