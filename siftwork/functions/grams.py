"""Runs of characters of whole text columns, counted batch by batch without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Characters that are counted at once.
CHUNK = 1 << 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def counted(texts: list[str], n: int, start: str, end: str) -> tuple[list[str], np.ndarray]:
    """The runs of n characters that end at a character of a text or at its end mark, and how often each occurs.

    Characters are numbered within the chunk and a run is a number to that base, so runs are told apart exactly
    and sorted as integers; where the base is too large for that, runs are numbered anew after each character.
    """
    lead = n - 1
    flat = _points("".join(start * lead + t + end for t in texts))
    sizes = np.array([len(t) for t in texts]) + lead + 1
    inside = np.ones(len(flat), bool)
    inside[(np.cumsum(sizes) - sizes)[:, None] + np.arange(lead)] = False
    points, ids = np.unique(flat, return_inverse=True)
    base, at = len(points), np.flatnonzero(inside)
    key, names = ids[at - lead], points[:, None]  # names: the characters behind each number
    if base**n < 1 << 62:
        for k in range(1, n):
            key = key * base + ids[at - lead + k]
        kinds, counts = np.unique(key, return_counts=True)
        names = points[np.stack([kinds // base ** (n - 1 - k) % base for k in range(n)], axis=1)]
    else:
        for k in range(1, n):
            kinds, key, counts = np.unique(key * base + ids[at - lead + k], return_inverse=True, return_counts=True)
            names = np.concatenate([names[kinds // base], points[kinds % base][:, None]], axis=1)
        if n == 1:
            kinds, counts = np.unique(key, return_counts=True)
            names = points[kinds][:, None]
    whole = names.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[k : k + n] for k in range(0, len(whole), n)], counts


def counter(n: int, start: str, end: str):
    """A function of batches of one text column: rows (gram, n) for each chunk of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in frames:
            for text in pdf.iloc[:, 0]:
                held.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield pd.DataFrame(dict(zip(("gram", "n"), counted(held, n, start, end), strict=True)))
                    held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("gram", "n"), counted(held, n, start, end), strict=True)))

    return run
