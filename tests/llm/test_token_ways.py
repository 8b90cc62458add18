"""Token shards: stretches of the stream that are broadcast or joined give the same slots; null and repeated rows are in their places."""

from siftwork.llm import token_shards

from .common import documents, frame


def slots(spark):
    manifest, folder, total = token_shards.materialise(frame(spark).coalesce(1), length=64, shard=4)
    return total, {r.slot: list(r.ids) for r in token_shards.read(manifest, folder, length=64, shard=4).collect()}


def test_both_ways_to_place_stretches(spark, monkeypatch):
    broadcast = slots(spark)
    monkeypatch.setattr(token_shards, "BROADCAST_STRETCHES", 0)
    assert slots(spark) == broadcast
    total, found = broadcast
    encode = token_shards._tiktoken(token_shards.vocabulary())
    stream = [t for row in documents() for t in (*encode(row[1] or ""), token_shards.END)]
    n = -(-total // 64)
    stream += [token_shards.END] * (n * 64 - total)
    assert total == sum(len(encode(r[1] or "")) + 1 for r in documents()) and sorted(found) == list(range(n))
    where = token_shards.permute(token_shards.np.arange(n), n)
    assert all(found[int(s)] == stream[k * 64 : (k + 1) * 64] for k, s in enumerate(where))
