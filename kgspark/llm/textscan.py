"""Vectorised scanning of text batches: letters, words, sentences and their hashes as numpy arrays.

A batch of texts is one array of code points; words and sentences are index arrays into it,
so no Python object is made per word. ``slices`` keeps a batch under a number of characters,
which bounds the memory of a task (a single longer text is a batch of its own).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Characters of a batch.
BATCH = 1_000_000
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point of the basic plane: 1 for letters and the marks that combine with them."""
    import unicodedata

    return np.array([chr(c).isalpha() or unicodedata.category(chr(c)) in ("Mn", "Mc") for c in range(0x10000)], dtype=np.uint8)


@lru_cache(maxsize=1)
def blanks() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x10000)], dtype=bool)


def of(table: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """The table's value of each code point; code points beyond the basic plane have that of U+FFFF."""
    return table[np.minimum(cp, 0xFFFF)]


def slices(texts: Sequence[str], most: int = BATCH) -> Iterator[slice]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by a line break; start of each text, and the end)."""
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return cp, starts


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true values."""
    d = np.diff(np.concatenate([[False], flag.astype(bool), [False]]).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, BATCH + 2), np.uint64(base), dtype=np.uint64)
        p[0] = 1
        have = _powers[name] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of code points, by its content alone."""
    s = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * _power(_R, len(cp), "p"), out=s[1:])
    h = (s[ends] - s[starts]) * _power(_R_INV, len(cp) + 1, "q")[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
