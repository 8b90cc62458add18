"""Exact and near duplicates of fragments, and overlaps between them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scan import hashes, pieces, windows, words
from ..functions.text import spaced_words
from ..sources.shared import written


# --- fixed values: ranges of hashes of n-grams, entries that are packed at once, tasks that take the ranges ---
BUCKETS, HELD, GRAM_TASKS = 1024, 1 << 22, 64
#: The most texts of a batch of entries, and the number that stands for more than one text.
MORE = 0xFFFF


def content_hash(text: Column) -> Column:
    """MD5 of the text with white space made single spaces; case counts."""
    return F.md5(F.array_join(spaced_words(text), " "))


def mark_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, duplicate_of): the smallest key with the same content, null for the first.

    Contents are grouped by their hash with partial aggregation, so a group of copies of any size is cheap,
    and no text is shuffled.
    """
    hashed = df.select(key, content_hash(F.col(text)).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min(key).alias("first"))
    return hashed.join(first, "hash").select(key, F.when(F.col("first") != F.col(key), F.col("first")).alias("duplicate_of"))


def _fingerprint(words: list[str]) -> int:
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or words
    if not grams:
        return 0
    h = np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[:8] for g in grams), "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, simhash): the majority bits of the MD5 of lower-case word trigrams, as a signed long."""
    rows = df.select(key, spaced_words(F.lower(text)).alias("words"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "simhash": [_fingerprint([] if w is None else list(w)) for w in pdf["words"]]})

    return rows.mapInPandas(run, f"{key} long, simhash long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(value: Column, distance: int) -> Column:
    """distance + 1 slices of 64 bits, numbered: of two values within the distance, one slice is equal."""
    m = distance + 1
    sizes = [64 // m + (k < 64 % m) for k in range(m)]
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(value, sum(sizes[:k])).bitwiseAND((1 << n) - 1).alias("slice")) for k, n in enumerate(sizes)])


def close_pairs(prints: DataFrame, distance: int = 3, key: str = "doc_id") -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints' smallest keys within the distance, by an equal slice.

    Copies are one representative, so groups of copies make no pairs.
    """
    distinct = prints.groupBy("simhash").agg(F.min(key).alias("id"))
    cut = distinct.select("id", "simhash", F.inline(bands(F.col("simhash"), distance)))
    a, b = cut.alias("a"), cut.alias("b")
    d = hamming(F.col("a.simhash"), F.col("b.simhash"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.simhash") < F.col("b.simhash")) & (d <= distance))
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), d.alias("distance")).distinct()


class _Tile:
    """Distances of a few fingerprints to many, in buffers that are used again and fit the cache."""

    ROWS = 32

    def __init__(self):
        self.bits, self.far = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.uint8)

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.bits.shape != (len(x), len(y)):
            self.bits, self.far = np.empty((len(x), len(y)), np.int64), np.empty((len(x), len(y)), np.uint8)
        np.bitwise_xor(x[:, None], y[None, :], out=self.bits)
        return np.bitwise_count(self.bits.view(np.uint64), out=self.far)


def nearest_earlier(prints: DataFrame, known: DataFrame, q_cuts: int, x_cuts: int, k: int = 3, farthest: int = 24) -> DataFrame:
    """Rows (doc_id, near, distance): of the rows of known of smaller doc_ids, the k nearest by Hamming distance, ties to
    the smaller doc_id; none where the nearest is over `farthest` bits away.

    All pairs are held against each other, in q_cuts by x_cuts blocks. Of equal fingerprints of known, only the k of
    the smallest doc_ids can be among the nearest. Every member of a group of copies is asked for itself.
    """
    least = known.withColumn("r", F.row_number().over(Window.partitionBy("simhash").orderBy("doc_id"))).where(F.col("r") <= k)
    q = prints.withColumn("q", F.pmod(F.xxhash64("doc_id"), F.lit(q_cuts)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(x_cuts - 1))))
    x = least.select("doc_id", "simhash", F.pmod(F.xxhash64("doc_id"), F.lit(x_cuts)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(q_cuts - 1))).alias("q"))

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        qid, qh = asked["doc_id"].to_numpy(), asked["simhash"].to_numpy()
        xid, xh = rows["doc_id"].to_numpy(), rows["simhash"].to_numpy()
        out, n, taken = [], len(xid), min(k, len(xid))
        later, tile = np.searchsorted(xid, qid), _Tile()
        for at in range(0, len(qid) if n else 0, _Tile.ROWS):
            far = tile.distances(qh[at : at + _Tile.ROWS], xh)
            for row, cut in enumerate(later[at : at + _Tile.ROWS]):
                far[row, cut:] = 65
            for _ in range(taken):  # the first of the nearest has the smallest doc_id
                best = far.argmin(axis=1)
                rows_ = np.arange(len(far))
                near = far[rows_, best]
                some = np.flatnonzero(near < 65)
                out.append((qid[at + some], xid[best[some]], near[some].astype(np.int32)))
                far[rows_, best] = 65
        return pd.DataFrame(dict(zip(("doc_id", "near", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {"doc_id": [], "near": [], "distance": []})

    met = q.groupBy("q", "x").cogroup(x.groupBy("q", "x")).applyInPandas(run, "doc_id long, near long, distance int")
    w = Window.partitionBy("doc_id").orderBy("distance", "near")
    met = met.withColumn("r", F.row_number().over(w)).withColumn("nearest", F.first("distance").over(w))
    return met.where((F.col("r") <= k) & (F.col("nearest") <= farthest)).select("doc_id", "near", "distance")


def clone_type(distance: Column) -> Column:
    """Type 1 up to 2 bits, type 2 up to 8, type 3 beyond."""
    return F.when(distance <= 2, "type1").when(distance <= 8, "type2").otherwise("type3")


def _grams(column, sizes: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of rows i to j: the number of words of each, and the place and levels of each distinct start of its n-grams.

    The n-grams that start at one word are one entry: the hash of the shortest, then, for each next size, 32 bits of the
    words that it has more; 0 where the text ends before. Two n-grams are equal if they are so in all levels up to theirs.
    """
    for i, j, b, off in pieces(column):
        starts, ends = words(b, off)
        h = hashes(b, starts, ends)
        count = np.diff(np.searchsorted(starts, off))
        owner = np.repeat(np.arange(j - i), count)
        whole = windows(h, sizes[0])
        at = np.flatnonzero(owner[: len(whole)] == owner[sizes[0] - 1 :])
        o, levels = owner[at], [whole[at]]
        for n, m in zip(sizes, sizes[1:], strict=False):
            more = (windows(h[n:], m - n) >> np.uint64(32)).astype(np.uint32)
            level = np.zeros(len(at), np.uint32)
            inside = np.flatnonzero(at + m <= len(h))
            inside = inside[owner[at[inside] + m - 1] == o[inside]]
            level[inside] = np.maximum(more[at[inside]], 1)
            levels.append(level)
        order = np.lexsort((*levels[::-1], o))
        o, levels = o[order], [x[order] for x in levels]
        new = _starts(o, *levels)
        yield i, j, count, o[new], [x[new] for x in levels]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Flags of the sorted rows that differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _packed(levels: list[np.ndarray], text: np.ndarray) -> bytes:
    """Entries of a bucket, sorted: their number, then of each level flags of what is new and its values; the first as steps of as few bytes as do."""
    fresh = np.zeros(len(text), bool)
    fresh[:1] = True
    out = [np.array([len(text)], np.uint32).tobytes()]
    for k, level in enumerate(levels):
        fresh[1:] |= level[1:] != level[:-1]
        values = level[fresh]
        out.append(np.packbits(fresh).tobytes())
        if k == 0:
            steps = np.diff(values, prepend=np.uint64(0))
            steps[0] = values[0] & np.uint64((1 << 64) // BUCKETS - 1)  # the rest is the bucket's number
            width = max(1, -(-int(steps.max()).bit_length() // 8))
            out += [bytes([width]), steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
        else:
            out.append(values.astype("<u4").tobytes())
    out.append(text.astype("<u2").tobytes())
    return b"".join(out)


def _unpacked(data: bytes, bucket: int, n_levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, at = int.from_bytes(data[:4], "little"), 4
    levels = []
    for k in range(n_levels):
        fresh = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n)
        at += -(-n // 8)
        count = int(fresh.sum())
        if k == 0:
            width, steps = data[at], np.zeros((count, 8), np.uint8)
            steps[:, :width] = np.frombuffer(data, np.uint8, count * width, at + 1).reshape(-1, width)
            values = np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64) + np.uint64(bucket * ((1 << 64) // BUCKETS))
            at += 1 + count * width
        else:
            values = np.frombuffer(data, "<u4", count, at)
            at += 4 * count
        levels.append(values[np.cumsum(fresh, dtype=np.int64) - 1])
    return levels, np.frombuffer(data, "<u2", n, at)


def _gram_buckets(sizes: tuple[int, ...]):
    """Rows (bucket, batch, data, keys, words, t2, ...): the entries of every few million that are in a range of hashes, and, in one
    row behind them, the batch's keys with their numbers of words and of distinct n-grams."""
    edges = np.arange(1, BUCKETS, dtype=np.uint64) * np.uint64((1 << 64) // BUCKETS)
    names = ["bucket", "batch", "data", "keys", "words", *[f"t{n}" for n in sizes]]

    def flush(batch: int, texts: list[np.ndarray], held: list[list[np.ndarray]], keys: list[pa.Array], sums: list[list[np.ndarray]]) -> pa.RecordBatch:
        text, levels = np.concatenate(texts), [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort(levels[::-1])  # stable, so the texts of equal entries stay in order
        text, levels = text[order], [x[order] for x in levels]
        at = np.flatnonzero(_starts(*levels))
        text = np.where(np.diff(np.append(at, len(text))) == 1, text[at], MORE)  # an entry is there once for a text
        levels = [x[at] for x in levels]
        cut = np.concatenate([[0], np.searchsorted(levels[0], edges), [len(text)]])
        full = np.flatnonzero(np.diff(cut))
        data = [_packed([x[cut[b] : cut[b + 1]] for x in levels], text[cut[b] : cut[b + 1]]) for b in full]
        n = len(full)
        key = pa.concat_arrays(keys)
        last = lambda values: pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1), len(values)).astype(np.int32)), values)
        columns = [last(pa.array(np.concatenate(x).astype(np.int64))) for x in sums]
        return pa.RecordBatch.from_arrays([pa.array(np.append(full, batch % BUCKETS).astype(np.int32)), pa.array(np.full(n + 1, batch)), pa.array([*data, None], pa.binary()), last(key), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch, size, n = TaskContext.get().partitionId() << 32, 0, 0
        texts, held, keys, sums = [], [], [], [[] for _ in range(len(sizes) + 1)]
        for rows in batches:
            for i, j, count, o, levels in _grams(rows.column(1), sizes):
                for a in range(0, j - i, MORE):  # of very short texts a piece may have more
                    b = min(a + MORE, j - i)
                    if n + b - a > MORE or size >= HELD:
                        yield flush(batch, texts, held, keys, sums)
                        batch, size, n = batch + 1, 0, 0
                        texts, held, keys, sums = [], [], [], [[] for _ in range(len(sizes) + 1)]
                    p, q = np.searchsorted(o, [a, b])
                    mine, own = o[p:q] - a, [x[p:q] for x in levels]
                    texts.append((mine + n).astype(np.int32))
                    held.append(own)
                    keys.append(rows.column(0).slice(i + a, b - a))
                    sums[0].append(count[a:b])
                    for k in range(len(sizes)):
                        new = _starts(mine, *own[: k + 1]) & (own[k] > 0 if k else True)
                        sums[k + 1].append(np.bincount(mine[new], minlength=b - a))
                    n, size = n + b - a, size + q - p
        if n:
            yield flush(batch, texts, held, keys, sums)

    return run


def _alone(sizes: tuple[int, ...], kind: pa.DataType):
    """Of a bucket: how many n-grams of each size each text has that no other has; and the rows of keys, a row for each key."""
    names = ["batch", "text", "key", "words", *[f"t{n}" for n in sizes], *[f"u{n}" for n in sizes]]

    def run(bucket: pa.Table) -> pa.Table:
        out, parts = [], []
        for row in range(bucket.num_rows):
            of = lambda name: bucket.column(name)[row]  # noqa: B023, E731
            batch, data = of("batch").as_py(), of("data")
            if data.is_valid:
                parts.append((batch, *_unpacked(data.as_py(), of("bucket").as_py(), len(sizes))))
                continue
            keys = of("keys").values
            whole = lambda x: pa.array(np.full(len(keys), x, np.int64))  # noqa: B023, E731
            out.append(pa.Table.from_arrays([whole(batch), pa.array(np.arange(len(keys), dtype=np.int64)), keys, *[of(c).values for c in ("words", *[f"t{n}" for n in sizes])], *[whole(0) for _ in sizes]], names=names))
        if parts:
            levels = [np.concatenate(x) for x in zip(*[p[1] for p in parts], strict=True)]
            text = np.concatenate([p[2] for p in parts]).astype(np.int64)
            several = text == MORE
            batches = np.array([p[0] for p in parts], np.int64)
            text |= np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]) << 16
            order = np.lexsort(levels[::-1])
            levels, text, several = [x[order] for x in levels], text[order], several[order]
            first, found = np.zeros(len(text), bool), []
            first[:1] = True
            for k, level in enumerate(levels):
                first[1:] |= level[1:] != level[:-1]
                at = np.flatnonzero(first)
                same = np.minimum.reduceat(text, at) == np.maximum.reduceat(text, at)
                alone = same & ~np.logical_or.reduceat(several, at) & (level[at] > 0 if k else True)
                found.append(text[at[alone]])
            own, place = np.unique(np.concatenate(found), return_inverse=True)
            cuts = np.cumsum([0, *map(len, found)])
            counts = [pa.array(np.bincount(place[a:b], minlength=len(own))) for a, b in zip(cuts, cuts[1:], strict=False)]
            none = pa.nulls(len(own), pa.int64())
            out.append(pa.Table.from_arrays([pa.array(batches[own >> 16]), pa.array(own & MORE), pa.nulls(len(own), kind), none, *[none for _ in sizes], *counts], names=names))
        return pa.concat_tables(out)

    return run


def gram_shares(df: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, words, s2, s3, ...): of a text's distinct n-grams of each size, the share that another text has too.

    N-grams are 64-bit hashes of the shortest size and 32 bits more for each next. They go through one shuffle, packed: the
    n-grams that start at one word are one entry, sorted entries are steps from one to the next, and a text is its number
    in a batch of some million entries, or the mark of several. Texts are scanned once: a batch's keys and totals go with
    it. There are so many tasks behind the shuffle whatever the session's setting, as each gives a row for a text.
    A text with fewer words than an n-gram has a null share. df's partitions have to give the same rows again in order.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), text)
    arrow = to_arrow_type(rows.schema["key"].dataType)
    totals = ["words", *[f"t{n}" for n in sizes]]
    packed = rows.mapInArrow(_gram_buckets(sizes), f"bucket int, batch bigint, data binary, keys array<{kind}>, {', '.join(f'{c} array<bigint>' for c in totals)}")
    counted = packed.repartition(GRAM_TASKS, "bucket").groupBy("bucket").applyInArrow(_alone(sizes, arrow), f"batch bigint, text bigint, key {kind}, {', '.join(f'{c} bigint' for c in (*totals, *[f'u{n}' for n in sizes]))}")
    out = counted.groupBy("batch", "text").agg(F.max("key").alias(key), *[F.max(c).alias(c) for c in totals], *[F.sum(f"u{n}").alias(f"u{n}") for n in sizes])
    share = lambda n: F.coalesce(F.col(f"u{n}") / F.nullif(F.col(f"t{n}"), F.lit(0)), F.lit(0.0))
    return out.select(key, "words", *[F.when(F.col("words") >= n, 1 - share(n)).alias(f"s{n}") for n in sizes])


def redundancy(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, redundancy): shares of 2-, 3- and 4-grams found in other texts, weighted by the text's length.

    Where a text is too short for an n-gram, the share of the next shorter counts.
    """
    rows = gram_shares(df, (2, 3, 4), key, text)
    two, three, four = F.coalesce("s2", F.lit(0.0)), F.coalesce("s3", "s2", F.lit(0.0)), F.coalesce("s4", "s3", "s2", F.lit(0.0))
    n = F.col("words")
    mix = F.when(n < 2, 0.0).when(n < 20, 0.55 * two + 0.35 * three + 0.1 * four).when(n < 100, 0.25 * two + 0.5 * three + 0.25 * four).otherwise(0.15 * two + 0.35 * three + 0.5 * four)
    return rows.select(key, mix.alias("redundancy"))


def uniqueness(prints: DataFrame, sample: int = 50, key: str = "doc_id", value: str = "simhash") -> DataFrame:
    """Rows (key, uniqueness) of the fragments behind a sample of the first ones: one less the greatest similarity to it.

    A fingerprint of 0 tells nothing (0.5), and nor does an empty sample (0.7). The sample is bounded by its size.
    """
    first = prints.orderBy(key).limit(sample)
    seen = first.agg(F.collect_list(value).alias("seen"), F.max(key).alias("last"))
    rest = prints.crossJoin(F.broadcast(seen)).where(F.col("last").isNull() | (F.col(key) > F.col("last")))  # one row
    near = F.array_max(F.transform("seen", lambda h: 1 - hamming(F.col(value), h) / 64))
    return rest.select(key, F.when(F.col(value) == 0, 0.5).when(F.size("seen") == 0, 0.7).otherwise(1 - near).alias("uniqueness"))


def pairs_within(prints: DataFrame, distance: int, key: str = "doc_id", value: str = "simhash", rows: int = 8_000) -> DataFrame:
    """Pairs (a, b, distance) of the smallest ids of different fingerprints at most `distance` bits apart.

    For distances at which no equal slice narrows the search: fingerprints meet in blocks of bounded size, each pair
    of blocks in one task, so the work is shared however many there are. Copies are one fingerprint.
    """
    from .fragments import blocked

    nodes = prints.groupBy(value).agg(F.min(key).alias("id"))
    n = nodes.count()

    def run(block, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        x, y = left[value].to_numpy(np.int64), right["other"].to_numpy(np.int64)
        ids, others, tile = left["id"].to_numpy(), right["other_id"].to_numpy(), _Tile()
        for k in range(0, len(x), _Tile.ROWS):
            far = tile.distances(x[k : k + _Tile.ROWS], y)
            r, c = np.divmod(np.flatnonzero(far <= distance), max(1, len(y)))
            a, b, d = ids[k + r], others[c], far[r, c].astype(np.int32)
            once = a < b if block[0] == block[1] else a != b
            out.append((np.minimum(a, b)[once], np.maximum(a, b)[once], d[once]))
        return pd.DataFrame(dict(zip(("a", "b", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    others = nodes.select(F.col(value).alias("other"), F.col("id").alias("other_id"))
    a, b = [side.where("i <= j") for side in blocked(nodes, others, rows, n, n, value, "other")]  # two blocks meet once
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, "a long, b long, distance int")


def far_pairs(prints: DataFrame, group: str, distance: int, key: str = "doc_id", value: str = "simhash", rows: int = 4_000) -> DataFrame:
    """Pairs (a, b) of keys of one group, a before b, whose fingerprints are at least `distance` bits apart.

    Most pairs of a group may be of this kind, so the result grows with the square of a group. Its rows are numbered
    by key and cut into blocks of so many, and each two blocks of a group meet once: a task holds a block at a time
    however large the group is, and all tasks share the work. A block behind another has the greater keys, so a
    key's pairs lie together.
    """
    spark = prints.sparkSession
    place = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    nodes = written(prints.where(F.col(group).isNotNull()).withColumn("block", (place / rows).cast("int")), "dedup-blocks")
    last = nodes.groupBy(group).agg(F.max("block").alias("last"), F.count("*").cast("double").alias("n"))
    blocks, pairs = last.agg(F.sum((F.col("last") + 1) * (F.col("last") + 2) / 2), F.sum(F.col("n") * F.col("n") / 2)).first()
    # a task for each pair of full blocks; fewer rows go to the partitions that the session has
    tasks = int(max(min(blocks or 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-(pairs or 1) // (rows * rows / 2))))
    left = nodes.join(last, group).select(group, F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.col(key).alias("a"), F.col(value).alias("x"))
    right = nodes.select(group, F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col(key).alias("b"), F.col(value).alias("y"))
    met = left.repartition(tasks, group, "i", "j").join(right.repartition(tasks, group, "i", "j"), [group, "i", "j"])
    return met.where((F.col("a") < F.col("b")) & (hamming(F.col("x"), F.col("y")) >= distance)).select("a", "b")
