"""Line dedup (1): an exact set-similarity join over the lines of all documents removes later matches.

A line is the set of its words. Words are ordered by rarity; two sets of a Jaccard similarity of t or more share
a word among the first of each (prefix filter). Lines that share such a word are candidates unless their sizes
(length filter), the word's places (positional filter) or the parity of their hashed words rule it out, and
are then verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, counts_of, drop, tidy, written
from ..functions.scan import hashes, lines, mix, pieces, words

#: The similarity from which lines match, as a fraction.
NUM, DEN = 4, 5
#: log2 of the table of word counts that orders words by rarity.
COUNT_BITS = 20
#: Bits of the hash that picks lines to verify, and the least and greatest log2 of the table of flags under it.
PICK_BITS, LEAST_FLAGS, MOST_FLAGS = 30, 16, 27
#: Lines of more words have a parity of 128 bits; in 64 the words of long lines would fill all places.
WIDE = 40
#: Postings for a task; candidates of a line for one word that are verified at first, and of very close ones.
TASK, FIRST, SURE = 300_000, 1024, 4
#: Equal lines that a scanning task remembers from one block of postings to the next.
KNOWN = 200_000
#: Buckets of lines by hash that tell which lines have many partners, and the partners for a task.
HEAT, PARTNERS = 1 << 14, 2_000
#: Lines that are still open then, and words of them, that one more scan of all lines is held against.
OPEN_LINES, OPEN_WORDS = 20_000, 2_000_000
_ID_BITS, _RANK_BITS = 44, 6
_TOKEN = np.uint64((1 << (_ID_BITS + _RANK_BITS)) - 1)
_GROUP = 1 << 13
_COLUMNS = (("token", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("line", "<u4"), ("size", "<u4"), ("place", "<u4"), ("sum", "<u4"), ("parity", "<u8"), ("more", "<u8"))
_FOUND = "kind int, near int, doc bigint, version bigint, line int, y_doc bigint, y_version bigint, y_line int, pick int, y_pick int, doc_pick int, y_doc_pick int"


def _word_buckets(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (hashes(b, *words(b, off)) >> np.uint64(64 - COUNT_BITS)).astype(np.int32)


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The rank of each bucket of hashed words (rare ones first), and the number of words, over all documents.

    The table has a fixed size. Words that share a bucket share a rank, which costs speed, not matches: any
    order of words that is the same for all lines is exact.
    """
    counts = counts_of(docs.select("text"), COUNT_BITS, _word_buckets)
    return np.minimum(2 * np.log2(counts + 1), (1 << _RANK_BITS) - 1).astype(np.uint64), int(counts.sum())


def line_sets(b: np.ndarray, off: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of lines that have words: (document, number in the document, offsets, words), words by rarity."""
    starts, ends = words(b, off)
    h = hashes(b, starts, ends)
    token = ranks[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] << np.uint64(_ID_BITS) | h & np.uint64((1 << _ID_BITS) - 1)
    l_starts, _, l_doc = lines(b, off)
    number = np.arange(len(l_doc)) - np.searchsorted(l_doc, l_doc)
    owner = np.searchsorted(l_starts, starts, "right") - 1
    filled, at = np.unique(owner, return_index=True)
    at = np.append(at, len(owner))
    for k in range(0, len(filled), _GROUP):
        some = filled[k : k + _GROUP]
        cut = at[k : k + len(some) + 1]
        local = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(cut))
        key = np.sort(local << np.uint64(_ID_BITS + _RANK_BITS) | token[cut[0] : cut[-1]])
        key = key[np.append(True, key[1:] != key[:-1])]
        sizes = np.bincount((key >> np.uint64(_ID_BITS + _RANK_BITS)).astype(np.int64), minlength=len(some))
        yield l_doc[some], number[some], np.concatenate([[0], np.cumsum(sizes)]), key & _TOKEN


def _pick(doc: np.ndarray, version: np.ndarray, line: np.ndarray) -> np.ndarray:
    h = mix(mix(doc.astype(np.uint64) ^ mix(version.astype(np.uint64))) + line.astype(np.uint64))
    return (h >> np.uint64(64 - PICK_BITS)).astype(np.int32)


def _flag_bits(n: int) -> int:
    """log2 of the table of flags for n keys: sixteen places for a key, within fixed bounds."""
    return min(MOST_FLAGS, max(LEAST_FLAGS, int(n).bit_length() + 4))


def _flagged(table: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Whether the packed table has the flags of the picks on."""
    at = pick.astype(np.int64) >> (PICK_BITS - 3 - (len(table).bit_length() - 1))
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _packed(columns: dict[str, np.ndarray], where: np.ndarray, pack) -> bytes:
    """Columns as one compressed block; numbers are kept by byte planes, which pack better."""
    out = [np.uint32(where.size).tobytes()]
    for name, kind in _COLUMNS:
        values = columns[name][where].astype(kind)
        if name in ("doc", "version"):
            values = np.diff(values, prepend=values.dtype.type(0))
        out.append(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())
    return pack.compress(b"".join(out))


def _unpacked(data: bytes, unpack) -> dict[str, np.ndarray]:
    raw = np.frombuffer(unpack.decompress(data), np.uint8)
    n, at, out = int(raw[:4].view("<u4")[0]), 4, {}
    for name, kind in _COLUMNS:
        width = np.dtype(kind).itemsize
        values = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel()
        at += n * width
        out[name] = np.cumsum(values) if name in ("doc", "version") else values
    return out


class _Known:
    """The places of lines that a task has posted; of equal ones the earliest. Forgetting some costs postings only."""

    def __init__(self):
        self.kept = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.hits, self.new = np.zeros(0, np.int64), []

    def earlier(self, same, d, v, line, first) -> np.ndarray:
        """Flags of the lines that equal a known one from an earlier place. The others of `first` become known."""
        sig, kd, kv, kl = self.kept
        out = np.zeros(len(same), bool)
        at = np.searchsorted(sig, same)
        found = np.flatnonzero(at < len(sig))
        found = found[(sig[at[found]] == same[found]) & first[found]]
        k = at[found]
        x, y = (kd[k], kv[k], kl[k]), (d[found], v[found], line[found])
        before = (x[0] < y[0]) | ((x[0] == y[0]) & ((x[1] < y[1]) | ((x[1] == y[1]) & (x[2] < y[2]))))
        out[found[before]] = True
        np.add.at(self.hits, k, 1)
        keep = first & ~out
        self.new.append((same[keep], d[keep], v[keep], line[keep]))
        return out

    def settle(self) -> None:
        """Takes up what is new: lines met twice or more since, and what was of use before."""
        new = [np.concatenate(c) for c in zip(*self.new, strict=True)]
        of_old = np.concatenate([np.ones(len(self.hits), np.int64) + self.hits, np.ones(len(new[0]), np.int64)])
        sig, d, v, line = (np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(self.kept, new, strict=True))
        order = np.lexsort((line, v, d, sig))
        lead = np.flatnonzero(np.append(True, sig[order[1:]] != sig[order[:-1]])) if len(order) else order
        met = np.add.reduceat(of_old[order], lead) if len(lead) else of_old[:0]
        some = np.flatnonzero(met > 1)
        some = np.sort(some[np.argsort(-met[some], kind="stable")[:KNOWN]])
        self.kept = tuple(c[order[lead[some]]].astype(t) for c, t in zip((sig, d, v, line), (np.uint64, np.int64, np.int64, np.int64), strict=True))
        self.hits, self.new = np.zeros(len(some), np.int64), []


def _post(shared, parts: int):
    """Postings of each line's prefix, by the task that joins the word; lines that repeat one that the task has met are found at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = shared.value
        pack, held, n = zstandard.ZstdCompressor(level=1), [], 0
        known = _Known()

        def flush():
            columns = {name: np.concatenate([h[name] for h in held]) for name, _ in _COLUMNS}
            part = ((mix(columns["token"]) >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            blocks = [_packed(columns, order[cuts[k] : cuts[k + 1]], pack) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])

        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null((1 << 63) - 1))
            versions = np.asarray(batch.column(1))
            for i, _, b, off in pieces(batch.column(2)):
                for doc, line, at, token in line_sets(b, off, ranks):
                    size = np.diff(at)
                    mixed = mix(token)
                    total = np.add.reduceat(mixed, at[:-1])
                    bit = np.uint64(1) << (mixed >> np.uint64(58))
                    parity = np.bitwise_xor.reduceat(bit, at[:-1])
                    upper = np.bitwise_xor.reduceat(np.where(mixed & np.uint64(1), bit, np.uint64(0)), at[:-1])
                    upper[size <= WIDE] = 0
                    d, v = ids[i + doc], versions[i + doc]
                    same = mix(total ^ mix(parity + mix(size.astype(np.uint64))))
                    _, of, copies = np.unique(same, return_inverse=True, return_counts=True)
                    head = np.arange(len(size))
                    many = np.flatnonzero(copies[of] > 1)
                    if len(many):
                        # the earliest of equal lines stands for them
                        order = many[np.lexsort((line[many], v[many], d[many], of[many]))]
                        lead = np.append(True, of[order[1:]] != of[order[:-1]])
                        head[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
                    first = head == np.arange(len(size))
                    itself = ~first & (d == d[head]) & (v == v[head]) & (line == line[head])  # a repeated row
                    # a line that this task has posted before, from an earlier place
                    first &= ~known.earlier(same, d, v, line, first)
                    # up to three words, only equal sets match: their rarest word is enough to meet
                    prefix = np.where(size <= 3, 1, size - (NUM * size + DEN - 1) // DEN + 1)
                    # lines that repeat one of this chunk go on as such, under no word and of no size
                    prefix[~first] = 1
                    prefix[itself] = 0
                    k = np.repeat(np.arange(len(size)), prefix)
                    place = np.arange(len(k)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                    post = {"token": token[at[k] + place], "doc": d[k], "version": v[k], "line": line[k], "size": size[k], "place": place, "sum": total[k] >> np.uint64(32), "parity": parity[k] ^ upper[k], "more": upper[k]}
                    again = ~first[k]
                    post["token"][again] = mix(post["doc"][again].astype(np.uint64) + mix(post["line"][again].astype(np.uint64)))  # to any task
                    post["size"][again] = 0
                    held.append({name: post[name].astype(kind) for name, kind in _COLUMNS})
                    n += len(k)
                if n >= 500_000:
                    yield flush()
                    held, n = [], 0
                    known.settle()
        if held:
            yield flush()

    return run


def _in_order(c: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The rows by word, and by (document, version, line) within a word."""
    doc, line, version = c["doc"][rows], c["line"][rows], c["version"][rows]
    if len(rows) and doc.min() >= 0 and doc.max() < 1 << 42 and line.max() < 1 << 21:
        key = doc << 21 | line
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        if (version[order[1:]][equal] != version[order[:-1]][equal]).any():
            order = np.lexsort((line, version, doc))
    else:
        order = np.lexsort((line, version, doc))
    return rows[order[np.argsort(c["token"][rows[order]], kind="stable")]]


def _pairs(first: int | None, only: np.ndarray | None):
    """Candidates among the postings of this task's words: rows of kind 0 (a line that repeats an earlier one),
    1 (a line and an earlier candidate) and 2 (a line with more candidates than were given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        blocks = [_unpacked(x.as_py(), unpack) for batch in batches for x in batch.column(1)]
        if not blocks:
            return
        c = {name: np.concatenate([x.pop(name) for x in blocks]) for name, _ in _COLUMNS}
        del blocks

        def out(kind, x, y=None, near=None):
            near = np.zeros(len(x), np.int32) if near is None else near
            a = [c["doc"][x], c["version"][x], c["line"][x].astype(np.int32)]
            e = [c["doc"][y], c["version"][y], c["line"][y].astype(np.int32)] if y is not None else a
            for k in range(0, len(x), 1 << 15):
                s = slice(k, k + (1 << 15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a[0][s]), kind, np.int32)), pa.array(near[s]), *[pa.array(v[s]) for v in (*a, *e)], *[pa.array(_pick(v[0][s], v[1][s], v[2][s] * whole)) for whole in (1, 0) for v in (a, e)]],
                    names=["kind", "near", "doc", "version", "line", "y_doc", "y_version", "y_line", "pick", "y_pick", "doc_pick", "y_doc_pick"],
                )

        repeated = c["size"] == 0
        if only is None:
            yield from out(0, np.flatnonzero(repeated))
        order = _in_order(c, np.flatnonzero(~repeated))
        # equal sets under a word: the earliest stands for all
        with np.errstate(over="ignore"):
            same = mix(c["token"][order] ^ mix((c["parity"][order] ^ c["more"][order]) + mix(c["size"][order].astype(np.uint64) << np.uint64(32) | c["sum"][order].astype(np.uint64))))
        _, lead, of = np.unique(same, return_index=True, return_inverse=True)
        if only is None:
            # the same document and line twice is a repeated row, not a later line
            later = np.flatnonzero((lead[of] != np.arange(len(order))) & (c["place"][order] == 0))
            mine, head = order[later], order[lead[of[later]]]
            other = (c["doc"][mine] != c["doc"][head]) | (c["version"][mine] != c["version"][head]) | (c["line"][mine] != c["line"][head])
            yield from out(0, mine[other])
        order = order[np.sort(lead)]
        # by word, class of size and order: sizes of a match are of the same class or of neighbours
        kind = np.clip(np.log(c["size"][order]) / np.log(1.26), 0, 61).astype(np.uint64) + np.uint64(1)
        key = c["token"][order] << np.uint64(6) | kind
        at = np.argsort(key, kind="stable")
        order, key = order[at], key[at]
        size, place, lower, upper = (c[k][order] for k in ("size", "place", "parity", "more"))
        size, place = size.astype(np.int64), place.astype(np.int64)
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if len(key) else np.zeros(0, np.int64)
        turn = group << 32 | at  # at grows with the order of lines within a word
        asked = np.flatnonzero(size > 3)
        if only is not None and len(asked):
            x = order[asked]
            asked = asked[_flagged(only, _pick(c["doc"][x], c["version"][x], c["line"][x]))]
        given = np.zeros(len(key), np.int64)
        for step in (0, -1, 1) if len(asked) else ():
            other = key[asked] + np.uint64(step % (1 << 64))
            start = np.searchsorted(key, other)
            there = start < len(key)
            there[there] = key[start[there]] == other[there]
            active, start = asked[there], start[there]
            # the earlier lines of that class: from start on, so many
            count = np.searchsorted(turn, group[start] << 32 | at[active]) - start
            full = (count > 0) & (given[active] >= first) if first is not None else np.zeros(len(active), bool)
            yield from out(2, order[active[full]])
            active, start, count = active[~full], start[~full], count[~full]
            for j in range(1 << 62):
                more = count > j
                active, start, count = active[more], start[more], count[more]
                if not len(active):
                    break
                for k in range(0, len(active), 1 << 18):
                    x, y = active[k : k + (1 << 18)], start[k : k + (1 << 18)] + j
                    both, nx, ny = size[x] + size[y], size[x], size[y]
                    need = (NUM * both + NUM + DEN - 1) // (NUM + DEN)
                    fit = np.flatnonzero((DEN * np.minimum(nx, ny) >= NUM * np.maximum(nx, ny)) & (np.minimum(nx - place[x], ny - place[y]) >= need))
                    a, b = x[fit], y[fit]
                    # both halves of the parity where both lines have them, else the two laid over one another
                    low, high = lower[a] ^ lower[b], upper[a] ^ upper[b]
                    wide = (nx[fit] > WIDE) & (ny[fit] > WIDE)
                    near = np.where(wide, np.bitwise_count(low) + np.bitwise_count(high), np.bitwise_count(low ^ high)).astype(np.int32)
                    room = (both - 2 * need)[fit]
                    ok = near <= room
                    x, y, near, room = x[fit[ok]], y[fit[ok]], near[ok], room[ok]
                    given[x] += 1
                    if first is not None:
                        # as close as this: most likely a match, and then few others are needed
                        given[x[2 * near <= room]] += -(-first // SURE)
                    yield from out(1, order[x], order[y], near)
                if first is not None:
                    full = given[active] >= first
                    yield from out(2, order[active[full & (count > j + 1)]])
                    active, start, count = active[~full], start[~full], count[~full]

    return run


def _whole_sets(shared, picked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ranks, _), (wanted, wanted_docs) = shared.value, picked.value
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null((1 << 63) - 1))
            versions = np.asarray(batch.column(1))
            asked = np.flatnonzero(_flagged(wanted_docs, _pick(ids, versions, np.zeros_like(ids))))
            ids, versions = ids[asked], versions[asked]
            for i, _, b, off in pieces(batch.column(2).take(pa.array(asked))):
                for doc, line, at, token in line_sets(b, off, ranks):
                    d, v = ids[i + doc], versions[i + doc]
                    some = np.flatnonzero(_flagged(wanted, _pick(d, v, line)))
                    if len(some):
                        sizes = np.diff(at)[some]
                        take = np.repeat(at[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(token[take].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(v[some]), pa.array(line[some].astype(np.int32)), sets], names=["doc", "version", "line", "words"])

    return run


def _scan_open(shared, asked):
    """The open lines (document, version, line, words) that have a match among the earlier lines of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ranks, _), rows = shared.value, asked.value
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        index = sorted((int(t), u) for u, w in enumerate(sets) for t in w[: len(w) - (NUM * len(w) + DEN - 1) // DEN + 1])
        token_of, line_of = np.array([t for t, _ in index], np.uint64), np.array([u for _, u in index], np.int64)
        found: set[int] = set()
        some_word = np.zeros(1 << 22, bool)
        some_word[(token_of & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null((1 << 63) - 1))
            versions = np.asarray(batch.column(1))
            for i, _, b, off in pieces(batch.column(2)):
                # only documents that may have one of the words
                starts, ends = words(b, off)
                hit = np.flatnonzero(some_word[(hashes(b, starts, ends) & np.uint64((1 << 22) - 1)).astype(np.int64)])
                if not len(hit):
                    continue
                own = np.unique(np.searchsorted(off, starts[hit], "right") - 1)
                b = np.concatenate([b[off[d] : off[d + 1]] for d in own])
                off = np.concatenate([[0], np.cumsum(off[own + 1] - off[own])])
                for doc, line, at, token in line_sets(b, off, ranks):
                    doc = own[doc]
                    low, high = np.searchsorted(token_of, token), np.searchsorted(token_of, token, "right")
                    met = np.flatnonzero(high > low)
                    if not len(met):
                        continue
                    n = (high - low)[met]
                    u = line_of[np.repeat(low[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    x = np.repeat(np.searchsorted(at, met, "right") - 1, n)
                    for k in np.unique(x * len(sets) + u).tolist():
                        x1, u1 = divmod(k, len(sets))
                        size, other = at[x1 + 1] - at[x1], len(sets[u1])
                        place = (int(ids[i + doc[x1]]), int(versions[i + doc[x1]]), int(line[x1]))
                        if u1 not in found and DEN * min(size, other) >= NUM * max(size, other) and place < rows[u1][:3]:
                            both = len(np.intersect1d(token[at[x1] : at[x1 + 1]], sets[u1], assume_unique=True))
                            if (NUM + DEN) * both >= NUM * (size + other):
                                found.add(u1)
        hits = [rows[u] for u in found]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32())], names=["doc", "version", "line"])

    return run


def _bit_table(df: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """A packed table of 2**bits flags, on where a row has the number (of PICK_BITS) in one of the columns."""
    places = df.select(F.explode(F.array(*[F.shiftright(c, PICK_BITS - bits) for c in columns])).alias("pick"))
    rows = places.select(F.shiftright("pick", 5).alias("word"), F.col("pick").bitwiseAND(31).alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("flags")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[np.asarray(rows["word"])] = np.asarray(rows["flags"]).astype(np.uint32)
    return table.view(np.uint8)


def removed_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc, version, line) of the lines to remove: doc is doc_id (the greatest long for null), version a hash
    of the text (0 for all if no doc_id comes twice), line counts from 0.

    A line goes if an earlier one, by (doc_id, version, line), has a similarity of NUM / DEN or more, whether
    that one stays or goes. Only the first few candidates of a line for a word are verified at first, which
    settles nearly all lines, however many near copies share the word. Lines that are still open then, and had
    more candidates, are held against all lines: by one more scan if they are few, else by joining again.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = keyed(docs.select("doc_id", "text").where("text is not null")).select("doc", "version", "text")
    shared = rarity(docs)
    parts = max(8, -(-shared[1] * (DEN - NUM) // DEN // TASK))
    shared = spark.sparkContext.broadcast(shared)
    posted = docs.mapInArrow(tidy(_post(shared, parts)), "part int, block binary").repartition(parts, "part")
    key, other = ["doc", "version", "line"], ["y_doc", "y_version", "y_line"]

    def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The lines of pairs whose sets are alike. Lines with many partners are dealt to several tasks, by a table of fixed size."""
        bucket = F.pmod(F.xxhash64(*other), F.lit(HEAT)).cast("int").alias("bucket")
        heat = pairs.groupBy(bucket).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")).where("salts > 1")
        y = sets.select(*[F.col(a).alias(b) for a, b in zip(key, other, strict=True)], F.col("words").alias("y_words")).withColumn("bucket", bucket)
        y = y.join(F.broadcast(heat), "bucket", "left").select(*other, "y_words", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        x = pairs.join(sets, key).withColumn("bucket", bucket).join(F.broadcast(heat), "bucket", "left")
        x = x.withColumn("salt", F.pmod(F.xxhash64(*key), F.coalesce("salts", F.lit(1))).cast("int")).drop("bucket", "salts")
        same = (NUM + DEN) * F.size(F.array_intersect("words", "y_words")) >= NUM * (F.size("words") + F.size("y_words"))
        return x.join(y, [*other, "salt"]).where(same).select(*key).distinct()

    def verified(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lines that match, and the sets of all candidates, both written."""
        pairs = found.where("kind = 1")
        bits = _flag_bits(2 * pairs.count())
        picked = spark.sparkContext.broadcast([_bit_table(pairs, c, bits) for c in (["pick", "y_pick"], ["doc_pick", "y_doc_pick"])])
        kept = docs.mapInArrow(tidy(_whole_sets(shared, picked)), "doc bigint, version bigint, line int, words array<bigint>")
        kept = written(kept, "sets")
        sets = kept.dropDuplicates(key)
        # the closest candidate settles most lines; only the others' sets are moved again
        closest = pairs.groupBy(*key).agg(F.min(F.struct("near", *other)).alias("y")).select(*key, *[f"y.{c}" for c in other])
        closest = written(closest, "closest")
        matched = written(alike(closest, sets), "matched")
        rest = pairs.select(*key, *other).join(closest.select(*key).join(matched, key, "left_anti"), key, "left_semi").distinct().join(closest, [*key, *other], "left_anti")
        rest = written(rest, "pairs")
        if not rest.isEmpty():
            ends = rest.select(*key).unionByName(rest.select(*[F.col(b).alias(a) for a, b in zip(key, other, strict=True)])).distinct()
            both = written(matched.unionByName(alike(rest, sets.join(ends, key, "left_semi"))), "matched")
            drop(matched)
            matched = both
        drop(closest, rest)
        return matched, kept

    found = written(posted.mapInArrow(tidy(_pairs(FIRST, None)), _FOUND), "candidates")
    matched, sets = verified(found)
    gone = written(found.where("kind = 0").select(*key).unionByName(matched).distinct(), "removed")
    open_ = written(found.where("kind = 2").select(*key, "pick").distinct().join(gone, key, "left_anti"), "open")
    lines_left = open_.count()
    drop(matched, found)
    if not lines_left:
        drop(sets, open_)
        return gone
    if lines_left <= OPEN_LINES:
        rows = open_.join(sets.dropDuplicates(key), key)
        if rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= OPEN_WORDS:
            rows = [(r["doc"], r["version"], r["line"], np.array(r["words"], np.int64).tobytes()) for r in rows.toLocalIterator()]
            drop(sets, open_)
            rest = docs.mapInArrow(tidy(_scan_open(shared, spark.sparkContext.broadcast(rows))), "doc bigint, version bigint, line int")
            return gone.unionByName(rest).distinct()
    drop(sets)
    rest = written(posted.mapInArrow(tidy(_pairs(None, _bit_table(open_, ["pick"], _flag_bits(lines_left)))), _FOUND), "candidates")
    more, sets = verified(written(rest.join(open_.select(*key), key, "left_semi").select(*found.columns), "candidates"))
    drop(sets, rest, open_)
    return gone.unionByName(more).distinct()


def keyed(docs: DataFrame, doc: str = "doc", version: str = "version") -> DataFrame:
    """docs with two columns which tell documents apart: without repeated doc_ids no text has to be hashed."""
    docs = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    once = docs.groupBy(doc).count().where("count > 1").isEmpty()
    return docs.withColumn(version, F.lit(0).cast("long") if once else F.xxhash64("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text rid of its removed lines, and the columns n_lines and n_removed.

    Lines are split at \\n, words at ASCII white space. Lines without a word never match. A text may lose all
    lines and become empty; null texts stay null. Rows repeated with one doc_id and text count as one
    document and fare alike; rows without a doc_id come after all others. An empty table gives an empty
    result. Columns of docs named as the new ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = removed_lines(docs).groupBy(F.col("doc").alias("_doc"), F.col("version").alias("_version")).agg(F.collect_list("line").alias("_gone"))
    columns, docs = docs.columns, keyed(docs, "__line_doc", "__line_version")
    cut = docs.join(gone, (docs["__line_doc"] == gone["_doc"]) & (docs["__line_version"] == gone["_version"]), "left").withColumn("_lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in columns]
    return cut.select(*columns, F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))
