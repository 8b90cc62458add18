"""Vectorised scanning of whole text columns: words, lines and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Bytes scanned at once: arrays of 8 bytes for each still fit a core's cache.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, out=table)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document is a range of its own."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def pieces(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last document + 1, bytes, offsets) for each range of documents."""
    b, off = buffers(column)
    for i, j in chunks(off, limit):
        yield i, j, b[off[i] : off[j]], off[i : j + 1] - off[i]


def words(b: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but space (a flag for each byte), as it comes ASCII white space; none crosses a document's end."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~space[b]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = off[:-1][off[:-1] < len(b)]
    first[at] = solid[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = solid[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lines(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and each line's document; an empty text is one empty line."""
    breaks = np.flatnonzero(b == 10)
    counts = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    return starts, ends, np.repeat(np.arange(len(off) - 1), counts)


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of b."""
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


class Counts:
    """Counts of small numbers that come in many short arrays."""

    def __init__(self, size: int):
        self.total, self.held, self.n = np.zeros(size, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.n += len(values)
        if self.n > 1 << 21:
            self.result()

    def result(self) -> np.ndarray:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=len(self.total))
            self.held, self.n = [], 0
        return self.total


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values of h."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(out)


def per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags (one per byte) for each document."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]
