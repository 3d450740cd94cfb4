"""Whole texts as arrays: word positions and 64-bit word hashes for many documents at once.

A word is a maximal run of characters other than space and U+0009 to U+000D. All of these are single bytes in UTF-8,
so the work is done on bytes. Hashes depend on a word's bytes only, never on its place, its batch or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
SPACES = bytes([0x20, *range(0x09, 0x0E)])
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[list(SPACES)] = 0
_BASE = np.uint64(0x9E3779B97F4A7C55)


class Words(NamedTuple):
    """Words of documents `first` to `first + n - 1` of a batch."""

    first: int
    n: int
    buf: np.ndarray  #: bytes of all texts, each followed by one space
    begin: np.ndarray  #: first byte of each document in buf; one more entry at the end
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    key: np.ndarray  #: uint64 hash of each word
    at: np.ndarray  #: index of each document's first word; one more entry at the end

    def doc(self) -> np.ndarray:
        """Document (0 to n - 1) of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.at))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_runs(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of each run buf[start:stop]; runs don't overlap and come in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lo, hi = int(start[0]), int(stop[-1])
    value = values[buf[lo:hi]]
    place = np.arange(hi - lo) - np.repeat(start - lo, np.diff(np.append(start, hi)))
    value = value * powers(int(place.max()) + 1)[place]
    bounds = np.stack([start, stop], 1).ravel() - lo
    sums = np.add.reduceat(np.append(value, np.uint64(0)), bounds)[::2]
    return mix(sums + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: list[str | None], chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of all texts (null: none), some megabytes at a time; one text is never split."""
    parts, size, first = [], 0, 0
    for i, text in enumerate(texts):
        parts.append((text or "").encode("utf-8", "replace"))
        size += len(parts[-1]) + 1
        if size >= chunk or i == len(texts) - 1:
            yield _words(parts, first)
            parts, size, first = [], 0, i + 1


def _words(parts: list[bytes], first: int) -> Words:
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return Words(first, len(parts), buf, begin, start, end, hash_runs(buf, start, end), np.searchsorted(start, begin))


def windows(key: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive entries, across document bounds too; length len(key) - size + 1, 0 at least."""
    n = max(0, len(key) - size + 1)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(size + 1)[1:]):
        out += key[j : j + n] * p
    return mix(out)


def inside(w: Words, size: int) -> np.ndarray:
    """Whether the window of `size` words from each place lies in one document; as long as windows()."""
    n = max(0, len(w.key) - size + 1)
    doc = w.doc()
    return doc[:n] == doc[size - 1 : size - 1 + n]
