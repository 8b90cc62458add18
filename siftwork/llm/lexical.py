"""Ranked lexical search (12): compressed postings by shard, merged document at a time, with a bounded heap of results."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from .common import bounded_batches, drop, tidy, written

#: What parts terms (any ASCII byte but digits and letters), and the bytes with A-Z lower-cased.
_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in a shard (a longer document is a shard of its own), and documents whose scores are summed at once.
SHARD_BYTES, WINDOW = 4 << 20, 8192
#: Rows of questions' terms that go to the tasks at once; more of them are asked in blocks.
BLOCK_TERMS = 200_000
K = 10
INDEX = "shard string, term string, df long, cf long, nulls int, ids binary, body binary"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of 7 bits each, low ones first, and where each number ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << (7 * k))
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        part = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[(ends - size)[has] + k] = part | ((size[has] > k + 1).astype(np.uint8) << np.uint8(7))
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    """The numbers that were packed."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * shift), first)


def _binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, start, length, hash) of all terms, and all bytes in lower case, 8 more behind them."""
    b, off = scan.buffers(texts)
    b = np.concatenate([_LOWER[b], np.zeros(8, np.uint8)])
    place = np.int32 if len(b) < 1 << 31 else np.int64
    parts: list[list[np.ndarray]] = [[] for _ in range(4)]
    for i, j in scan.chunks(off):
        piece = b[off[i] : off[j]]
        starts, ends = scan.words(piece, off[i : j + 1] - off[i], _BREAK)
        doc = np.searchsorted(off[i : j + 1] - off[i], starts, "right") - 1 + i
        for part, x, kind in zip(parts, (doc, starts + off[i], ends - starts, scan.hashes(piece, starts, ends)), (np.int32, place, place, np.uint64), strict=True):
            part.append(x.astype(kind))
    return (*[np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts], b)


def _ends_of(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 8 bytes of terms, as numbers."""
    at = np.ndarray(len(b) - 7, "<u8", b, strides=(1,))
    mask = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(size, 7) * 8).astype(np.uint64)) - np.uint64(1))
    return at[start] & mask, at[np.maximum(start, start + size - 8)] & mask


def shard_rows(name: str, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """The index of some documents: a head (term null) with their identifiers and lengths, then postings by term.

    Documents are numbered by identifier, those without one last; a posting is the step from the document
    before and the term's count in it, as packed numbers. Terms are told apart by a 64-bit hash, their length
    and their first and last 8 bytes. Documents without terms have no number.
    """
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    doc, start, size, h, b = _tokens(texts)
    lengths = np.bincount(doc, minlength=len(ids))
    if not len(doc):
        return None
    doc = (np.cumsum(lengths > 0, dtype=np.int32) - 1)[doc]
    by = np.argsort(h, kind="stable").astype(np.int32 if len(h) < 1 << 31 else np.int64)
    changes = lambda *xs: np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in xs])])
    new_term, told = changes(h[by]), changes(h[by], size[by], *_ends_of(b, start[by], size[by]))
    if (new_term != told).any():  # two terms share a hash: in order of all that tells them apart
        by = np.lexsort((doc, *_ends_of(b, start, size), size, h))
        new_term = changes(h[by], size[by], *_ends_of(b, start[by], size[by]))
    del h, told
    new = new_term | changes(doc[by])
    at = np.flatnonzero(new)
    tf = np.diff(np.concatenate([at, [len(by)]]))
    docs, firsts = doc[by][at], np.flatnonzero(new_term[at])
    step = np.diff(docs, prepend=docs.dtype.type(0))
    step[firsts] = docs[firsts]
    data, ends = packed(np.stack([step, tf], 1).ravel())
    lasts = np.concatenate([firsts[1:], [len(at)]])
    totals = np.add.reduceat(tf, firsts)
    one = by[at[firsts]]  # a token of each term
    term_ends = np.cumsum(size[one], dtype=np.int64)
    spread = np.repeat(start[one] - (term_ends - size[one]), size[one]) + np.arange(term_ends[-1])
    has = pa.array(lengths > 0)
    own, n = ids.filter(has), int((lengths > 0).sum())
    heads = pa.record_batch([
        pa.array([name]), pa.array([None], pa.string()), pa.array([n]), pa.array([len(doc)]), pa.array([own.null_count], pa.int32()),
        pa.array([pc.fill_null(own, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), pa.array([lengths[lengths > 0].astype("<i4").tobytes()], pa.binary()),
    ], names=NAMES)
    terms = pa.record_batch([
        pa.array([name]).take(pa.array(np.zeros(len(firsts), np.int32))), _binary(b[spread], term_ends, pa.string()), pa.array(lasts - firsts), pa.array(totals),
        pa.nulls(len(firsts), pa.int32()), pa.nulls(len(firsts), pa.binary()), _binary(data, ends[2 * lasts - 1], pa.binary()),
    ], names=NAMES)
    return pa.concat_batches([heads, terms])


NAMES = [x.split()[0] for x in INDEX.split(", ")]


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all terms of all rows, in shards of about SHARD_BYTES of text: no shuffle, one scan.

    Each task cuts what it reads into shards. A null text has no terms; repeated rows are documents of their
    own; the key is taken as a long and may be null; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids, texts = pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([x for _, x in held])
                rows = shard_rows(f"{task:06d}-{n:06d}", ids, texts)
                if rows is not None:
                    yield rows

        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            sizes = np.diff(scan.buffers(texts)[1])
            at = 0
            while at < len(sizes):
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SHARD_BYTES - size, "right")))
                if held and to == at + 1 and size + sizes[at] > SHARD_BYTES:
                    to = at  # not even one more
                else:
                    held.append((batch.column(0).slice(at, to - at), texts.slice(at, to - at)))
                    size += int(sizes[at:to].sum())
                if to < len(sizes) or size >= SHARD_BYTES:
                    yield from flush()
                    n, held, size = n + 1, [], 0
                at = to
        yield from flush()

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, INDEX)


def questions(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, term, times) of the questions' terms. Rows of one item_id are one question, null as well."""
    terms = F.regexp_extract_all(F.translate(F.col(text), _LETTERS, _LETTERS.lower()), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).cast("long").alias("item_id"), F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


class Shard:
    """A shard's documents, and the postings of the terms that were asked for, decoded when first met."""

    def __init__(self, head: dict, bodies: dict[str, bytes], weights: dict[str, int], n: int, length: int):
        self.ids = np.frombuffer(head["ids"], "<i8")
        self.first_null = len(self.ids) - head["nulls"]
        self.norm = 8 * (100 - 75 + (75 * np.frombuffer(head["body"], "<i4").astype(np.int64) * n) // length)
        self.bodies, self.weights, self.lists = bodies, weights, {}

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(documents in order, what one mention of the term in a question adds to their scores)."""
        if term not in self.lists:
            body = self.bodies.get(term)
            if body is None:
                self.lists[term] = None
            else:
                pairs = unpacked(body)
                docs, tf = np.cumsum(pairs[::2]), pairs[1::2]
                self.lists[term] = docs, self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + self.norm[docs]))
        return self.lists[term]

    def rank(self, terms: list[tuple[str, int]], best: list[tuple], k: int) -> None:
        """Puts the shard's documents into best, a heap of at most k (score, not null, -id), the worst on top.

        The terms' postings are cursors in a heap by their next document. The least of them opens a window of
        document numbers; all cursors that begin in it add their part of it to the documents' sums and go back
        with what is behind it, so every document is complete before the next window is opened.
        """
        cursors = [(int(found[0][0]), c, 0, found, times) for c, (term, times) in enumerate(terms) if (found := self.postings(term)) is not None]
        heapq.heapify(cursors)
        while cursors:
            low = cursors[0][0]
            sums = np.zeros(WINDOW, np.int64)
            while cursors and cursors[0][0] < low + WINDOW:
                _, c, at, found, times = cursors[0]
                docs, worth = found
                to = len(docs) if docs[-1] < low + WINDOW else int(np.searchsorted(docs, low + WINDOW))
                sums[docs[at:to] - low] += worth[at:to] * times
                if to < len(docs):
                    heapq.heapreplace(cursors, (int(docs[to]), c, to, found, times))
                else:
                    heapq.heappop(cursors)
            least = max(1, best[0][0] if len(best) == k else 1)
            open_ = np.flatnonzero(sums >= least)
            if len(open_) > k:  # of equal scores the first documents, whose identifiers are the smallest, come first
                open_ = open_[sums[open_] >= np.partition(sums[open_], -k)[-k]]
                open_ = open_[np.argsort(-sums[open_], kind="stable")][:k]
            for d in open_.tolist():
                known = low + d < self.first_null
                entry = (int(sums[d]), known, -int(self.ids[low + d]) if known else 0)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _ranked(asked: dict, weights: dict[str, int], n: int, length: int, k: int):
    """A task's function: shards in, one after another, the k best of each question over all of them out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = defaultdict(list)
        name, head, bodies = None, None, {}

        def close() -> None:
            if head is not None:
                shard = Shard(head, bodies, weights, n, length)
                for item, terms in asked.items():
                    shard.rank(terms, best[item], k)

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != name:
                    close()
                    name, head, bodies = r["shard"], None, {}
                if r["term"] is None:
                    head = r
                else:
                    bodies[r["term"]] = r["body"]
        close()
        rows = [(item, -e[2] if e[1] else None, e[0]) for item, heap in best.items() for e in heap]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents of highest score above 0 for each question, ties to the smaller doc_id.

    index is a written table that build() made; items have item_id and text. Statistics are those of all
    documents of the index. Postings of the questions' terms are brought together by shard, a task ranks all
    questions on its shards with one bounded heap a question, and the tasks' heaps are merged by a window over
    at most k rows of each task. Questions go to the tasks as a table of at most BLOCK_TERMS terms; with more
    they are asked block after block. An item without terms, or whose terms no document has, gives no rows;
    documents without an identifier rank last among equals.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    wanted = written(questions(items), "search-terms")
    heads = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("cf"), F.lit(0))).first()
    n, length = heads
    blocks = -(-wanted.count() // BLOCK_TERMS)
    found = None
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        vocabulary = mine.select("term").distinct()
        counts = index.where("term is not null").join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("df").alias("df"))  # at most BLOCK_TERMS
        weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
        asked, weights = defaultdict(list), {}
        for r in mine.join(F.broadcast(counts), "term").select("item_id", "term", "times", weight.alias("w")).orderBy("item_id", "term").toLocalIterator():
            if r.w > 0:
                asked[r.item_id].append((r.term, r.times))
                weights[r.term] = r.w
        terms = spark.createDataFrame([(t,) for t in weights], "wanted string")
        met = index.join(F.broadcast(terms), F.col("term") == F.col("wanted"), "left").where("term is null or wanted is not null").drop("wanted")
        met = met.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        part = met.mapInArrow(_ranked(dict(asked), weights, n, length, k), "item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    out = written(found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "search-found")
    drop(wanted)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written(build(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "search-index")
    out = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    drop(index)
    return out


_TERMS = f"regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '{TERM}')"
SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
 FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}"""
