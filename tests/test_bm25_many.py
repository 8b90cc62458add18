"""BM25 of many questions: texts are tokenised in one pass, and a task's sums are bounded."""

import pytest

from pyspark.sql import functions as F

from siftwork.operators import retrieval


def rows_of(df):
    return sorted((r.item_id, r.doc_id, r.matched, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("limit", [0, 500_000])
def test_one_pass_over_the_texts(spark, limit, monkeypatch):
    """Each text is seen once by the tokeniser, null texts count among the texts, and repeated keys stay apart by length."""
    seen = spark.sparkContext.accumulator(0)

    def look(t):
        seen.add(1)
        return t

    udf = F.udf(look, "string").asNondeterministic()
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, ""), (1, "alpha")], "doc_id long, text string").select("doc_id", udf("text").alias("text"))
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (2, "gamma delta")], "item_id long, text string")
    monkeypatch.setattr(retrieval, "TASK_COUNTS", 2)
    got = rows_of(retrieval.bm25_many(docs, questions, most_terms=limit))
    assert seen.value == (5 if limit else 10)
    want = []
    texts = [(1, ["alpha", "beta", "beta"]), (2, ["beta", "gamma"]), (4, []), (1, ["alpha"])]
    n, avg = 5, 6 / 4
    import math

    df = {"alpha": 2, "beta": 2, "gamma": 1}
    for item, asked in ((1, ["alpha", "beta"]), (2, ["gamma", "delta"])):
        for doc in (1, 2, 4):
            parts = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for d, w in texts if d == doc for t in asked if t in w]
            if parts:
                want.append((item, doc, len(parts), round(sum(parts) * (1 + 0.5 * (len(parts) / 2) ** 1.5), 9)))
    assert got == sorted(want)
