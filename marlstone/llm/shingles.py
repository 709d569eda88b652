"""Words and word shingles of whole texts as 64-bit hashes, by numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import GOLDEN, mix64

SPACE = 32
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


@lru_cache(maxsize=4)
def fold_table(kind: str) -> np.ndarray:
    """For each code point its lower case if it counts, else a space. kind: letter, or word (letters, digits, underscore)."""
    counts = str.isalpha if kind == "letter" else str.isalnum
    out = np.full(0x110000, SPACE, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if counts(c) or (kind == "word" and c == "_"):
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n; grown by doubling and kept."""
    have = _tables.get("up")
    if have is None or len(have) <= n:
        size = 1 << max(15, int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", _INVERSE)):
                a = np.ones(size, np.uint64)
                a[1:] = np.uint64(base)
                _tables[name] = np.multiply.accumulate(a)
    return _tables["up"], _tables["down"]


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and lower-cased hashes of the words of a text given by its code points, in order. Words are runs of letters, digits and underscores."""
    s = fold_table("word")[points]
    inside = s != SPACE
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    up, down = _powers(len(s) + 1)
    with np.errstate(over="ignore"):
        run = np.empty(len(s) + 1, np.uint64)
        run[0] = 0
        np.cumsum((s.astype(np.uint64) + np.uint64(1)) * up[: len(s)], out=run[1:])
        return start, end, mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word of the lower-cased text, in order."""
    return word_spans(code_points(text))[2] if text else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of `size` words; a shorter text is one shingle of all its words, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    take = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - take + 1, np.uint64(take), np.uint64)
        for i in range(take):
            h = mix64(h * np.uint64(BASE) + words[i : n - take + 1 + i])
    return h


def sequence_hash(words: np.ndarray) -> int:
    """One signed 64-bit hash of the whole word sequence: equal word sequences have equal hashes."""
    n = len(words)
    up, _ = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.sum(words * up[:n], dtype=np.uint64) if n else np.uint64(0)
        return int(mix64(np.array([total + np.uint64(n) * GOLDEN], np.uint64)).view(np.int64)[0])
