"""lrn39_knn_policy against all pairs."""

from siftwork.operators import dedup
from siftwork.plans import QUERIES


def test_knn_policy_has_all_votes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: r.simhash & (1 << 64) - 1 for r in dedup.simhash(docs.select("doc_id", "text")).collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in prints}
    want = {}
    for d, h in prints.items():
        near = sorted(((h ^ prints[x]).bit_count(), x) for x in quality if x < d)[:3]
        if near and near[0][0] <= 24:
            want[d] = (round(sum(quality[x] for _, x in near) / len(near), 6), len(near))
    assert {r.doc_id: (r.vote, r.n) for r in QUERIES["lrn39_knn_policy"](spark, sf).collect()} == want
    assert len(want) > 3
