"""Near copies: groups of documents linked by a Jaccard similarity of 0.8 or more between their sets of word shingles.

SimHash comes first: the fingerprints of op4, joined by its pigeonring, give pairs, and an exact check of whole sets
follows. No Hamming distance is sure to have all pairs of that similarity, so a join of the sets adds the rest: shingles
are ordered by rarity; two sets of that similarity share one among the first of each (prefix filter), unless sizes or
places rule the pair out (length and positional filters). Whole sets are compared for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, components, counts_of, drop, tidy, written
from .line_dedup import DEN, NUM, PICK_BITS, _bit_table, _flag_bits, _flagged
from ..functions.scan import hashes, mix, pieces, windows, words

#: log2 of the table of shingle counts that orders shingles by rarity; bits of a shingle's hash beside its rank.
COUNT_BITS, _ID_BITS = 20, 58
#: Differing bits at which fingerprints are linked; flags for a set that is asked for, beside those of line dedup.
DISTANCE, FLAGS = 2, 8
#: Places of a set's parity, and copies of documents to drop up to which they are broadcast.
PARITY, BROADCAST_GONE = 1024, 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(b: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and 64-bit hashes of all shingles; fewer words than a shingle has are one shingle."""
    starts, ends = words(b, off)
    h = hashes(_LOWER[b], starts, ends)
    doc = np.searchsorted(off, starts, "right") - 1
    whole = windows(h, width)
    inside = np.flatnonzero(doc[: len(whole)] == doc[width - 1 :]) if len(whole) else np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=len(off) - 1)
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.cumsum(counts) - counts
    few = [mix(windows(h[first[d] : first[d] + counts[d]], counts[d]) + np.uint64(counts[d])) for d in short]
    return np.concatenate([doc[inside], short]), np.concatenate([whole[inside], *few])


def shingle_sets(b: np.ndarray, off: np.ndarray, width: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by document, and each document's distinct shingles, the rare ones first."""
    doc, h = shingles(b, off, width)
    token = ranks[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] << np.uint64(_ID_BITS) | h & np.uint64((1 << _ID_BITS) - 1)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])) if len(doc) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(off) - 1))]), token[new]


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """The rank of each bucket of shingles, rare ones first: a table of fixed size. Any order is exact."""
    def buckets(b: np.ndarray, off: np.ndarray) -> np.ndarray:
        return (shingles(b, off, width)[1] >> np.uint64(64 - COUNT_BITS)).astype(np.int32)

    counts = counts_of(docs.select("text"), COUNT_BITS, buckets)
    return np.minimum(2 * np.log2(counts + 1), 63).astype(np.uint64)


def _signed(token: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token), dtype=np.uint64)])[ends]
    return mix(np.diff(sums) ^ mix(np.diff(ends).astype(np.uint64))).view(np.int64)


def _lists(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """values[at : at + size] of each row."""
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(at - ends[:-1], size) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[take].view(np.int64)))


def _parity(token: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each set the parity of its shingles' places, as numbers of 64 bits: two sets differ by at least as many shingles as bits."""
    n = len(ends) - 1
    place = np.repeat(np.arange(n) * PARITY, np.diff(ends)) + (mix(token) >> np.uint64(54)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * PARITY) & 1).astype(np.uint8).reshape(n, PARITY)
    words = np.packbits(odd, axis=1, bitorder="little").view("<i8").ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, PARITY // 64, dtype=np.int32)), pa.array(words))


def _print_batches(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in pieces(batch.column(1)):
                at, token = shingle_sets(b, off, width, shared.value)
                n = np.diff(at)
                prefix = np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)
                columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(_signed(token, at)), pa.array(n.astype(np.int32)), pa.array(simhash.fingerprints(b, off, width).view(np.int64)), _parity(token, at), _lists(token, at[:-1], prefix)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "sig", "n", "fp", "parity", "prefix"])

    return run


def _set_batches(width: int, shared, picked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b, off in pieces(batch.column(0)):
                at, token = shingle_sets(b, off, width, shared.value)
                sig = _signed(token, at)
                some = np.flatnonzero(_flagged(picked.value, (sig.view(np.uint64) >> np.uint64(64 - PICK_BITS)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig[some]), _lists(token, at[some], np.diff(at)[some])], names=["sig", "tokens"])

    return run


def _may_match(x, y):
    """Length filter, and positional filter at a common shingle, of sizes and places packed into one number."""
    nx, ny, px, py = F.shiftright(x, 32), F.shiftright(y, 32), x.bitwiseAND((1 << 32) - 1), y.bitwiseAND((1 << 32) - 1)
    sizes = DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)
    return sizes & ((NUM + DEN) * F.least(nx - px, ny - py) >= NUM * (nx + ny))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints SimHash links: of a fingerprint all with the least set, of linked ones the least sets."""
    least = written(nodes.groupBy("fp").agg(F.min("sig").alias("least")), "fingerprints")
    same = nodes.select("fp", "sig").join(least, "fp").where("sig <> least").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    side = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_least"))
    near = simhash.links(least.select("fp"), DISTANCE).join(side("a"), "a").join(side("b"), "b").select("a_least", "b_least")
    return same.unionByName(near.select(F.least("a_least", "b_least").alias("a"), F.greatest("a_least", "b_least").alias("b")))


def _one_of_each(prints: DataFrame) -> DataFrame:
    """A row of each signature. If the rows left out are few they are broadcast, and no set is moved."""
    first = prints.groupBy("sig").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    again = written(prints.select("sig", "row").join(first, "sig").where("row <> first").select("row"), "repeated-sets")
    if again.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE:
        return prints.join(F.broadcast(again), "row", "left_anti")
    return prints.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "fp", "parity", "prefix")])


def links(docs: DataFrame, prints: DataFrame, width: int, shared) -> DataFrame:
    """Edges (a, b) between signatures of sets whose components are those of all pairs of similarity 0.8 or more; prints go.

    First come the pairs of SimHash, and under each shingle the sets in order of size are held against the
    smallest and against the one before: two candidates for a posting, however crowded the shingle is. Then only
    sets that a shingle has in different components so far are joined in pairs, so a group of near copies makes
    no pairs of all. Of the candidates those whose parities differ in more places than alike sets can are
    dropped before whole sets are read.
    """
    sets = _one_of_each(prints)
    posts = sets.select("sig", "n", F.posexplode("prefix").alias("place", "token"))
    posts = posts.select("token", "sig", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("at"))
    w = Window.partitionBy("token").orderBy(F.shiftright("at", 32), "sig")
    posts = posts.select("token", "sig", "at", *[f(c).over(w).alias(f"{name}_{c}") for name, f in (("head", F.first), ("before", F.lag)) for c in ("sig", "at")], F.lead("sig").over(w).alias("after"))
    posts = written(posts.where("before_sig is not null or after is not null").drop("after"), "shared-shingles")
    nodes = written(sets.select("sig", "n", "fp", "parity"), "nodes")
    drop(prints)

    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def alike(pairs: DataFrame) -> DataFrame:
        of = nodes.select("sig", "n", "parity")
        side = lambda x: of.select(F.col("sig").alias(x), F.col("n").alias(f"{x}_n"), F.col("parity").alias(f"{x}_parity"))
        both = F.col("a_n") + F.col("b_n")
        far = F.aggregate(F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(far <= both - 2 * F.ceil(NUM * both / (NUM + DEN))).select("a", "b")
        pairs = written(pairs, "candidates")
        picks = pairs.select(*[F.shiftrightunsigned(c, 64 - PICK_BITS).cast("int").alias(c) for c in ("a", "b")])
        picked = docs.sparkSession.sparkContext.broadcast(_bit_table(picks, ["a", "b"], _flag_bits(FLAGS * 2 * pairs.count())))
        kept = written(docs.select("text").mapInArrow(tidy(_set_batches(width, shared, picked)), "sig bigint, tokens array<bigint>"), "sets")
        sets = kept.dropDuplicates(["sig"])
        whole = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("a_tokens")), "a").join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("b_tokens")), "b")
        same = (NUM + DEN) * F.size(F.array_intersect("a_tokens", "b_tokens")) >= NUM * (F.size("a_tokens") + F.size("b_tokens"))
        out = written(whole.where(same).select("a", "b"), "links")
        drop(kept, pairs)
        return out

    near = [posts.where(F.col("sig") != F.col(f"{y}_sig")).where(_may_match(F.col("at"), F.col(f"{y}_at"))).select(*ordered("sig", f"{y}_sig")) for y in ("head", "before")]
    first = written(fingerprint_pairs(nodes).unionByName(near[0]).unionByName(near[1]).distinct(), "pairs")
    if first.isEmpty():
        found, joined = None, posts.select("token", "sig", "at", F.col("sig").alias("component"))
    else:
        found = alike(first)
        named = components(found)
        joined = posts.select("token", "sig", "at").join(named, F.col("sig") == named.node, "left").select("token", "sig", "at", F.coalesce("component", "sig").alias("component"))
    mixed = joined.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    joined = written(joined.join(mixed, "token", "left_semi").select("token", "sig", "at", "component"), "mixed")
    drop(posts, None if found is None else named)
    x, y = joined.alias("x"), joined.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.sig") < F.col("y.sig")) & (F.col("x.component") != F.col("y.component")) & _may_match(F.col("x.at"), F.col("y.at")))
    rest = written(pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    drop(joined)
    more = None if rest.isEmpty() else alike(rest)
    drop(nodes)
    if found is None or more is None:
        return first.limit(0) if found is more else found if more is None else more
    return found.unionByName(more)


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without the near copies: of each group of linked rows the one of the smallest doc_id stays.

    Sets are those of lower-case (ASCII) word shingles; fewer words are one shingle, and null texts and texts
    without words are equal. Rows are judged by their texts: texts that share a doc_id are linked only if they
    are alike, and rows without a doc_id belong to groups too, but come after all others in them. Of several
    texts with one doc_id in a group that of the smallest hash stays, of rows that repeat both the one whose
    columns have the smallest hash. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, width))
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    prints = texts.mapInArrow(tidy(_print_batches(width, shared)), f"doc_id {kind}, version bigint, sig bigint, n int, fp bigint, parity array<bigint>, prefix array<bigint>")
    prints = written(prints.withColumn("row", F.monotonically_increasing_id()), "shingle-prefixes")
    rows = written(prints.select("doc_id", "version", "sig"), "rows")
    edges = written(links(docs, prints, width, shared), "links")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    lowest = rows.groupBy("sig").agg(F.min(place).alias("first"))
    if not edges.isEmpty():
        found = components(edges)
        joined = lowest.join(found, lowest.sig == found.node, "left").select("first", F.coalesce("component", "sig").alias("component"))
        lowest = joined.groupBy("component").agg(F.min("first").alias("first"))
    stay = lowest.select(F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version"))
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.version") == F.col("s.version"))
    gone = written(rows.select("doc_id", "version").distinct().alias("r").join(stay.alias("s"), same, "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")), "gone")
    few = gone.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE
    repeated = not rows.groupBy("doc_id", "version").count().where("count > 1").isEmpty()
    drop(rows, edges)
    dropped = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_version"))
    kept = docs.join(F.broadcast(gone) if few else gone, dropped, "left_anti")
    if not repeated:
        return kept
    row = F.struct(*docs.columns)
    once = kept.groupBy(F.col("doc_id").alias("stay_id"), F.xxhash64("text").alias("stay_version")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
    return once.select("row.*")
