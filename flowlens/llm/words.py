"""Words of texts as numpy arrays: places, hashes and grams of many documents at once.

A word is a run of bytes other than space and 0x09 to 0x0D, so words of UTF-8
text are found byte by byte.  All helpers work on blocks of whole documents of
a bounded number of bytes (one longer document makes a block of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_HASH_BYTES = 1 << 20
_LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    global _powers
    if _powers is None:
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(_HASH_BYTES + 1, base, dtype=np.uint64)
                steps[0] = 1
                tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Consecutive documents of one batch."""

    first: int  # row of the first document
    data: np.ndarray  # bytes of all documents
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    docs: np.ndarray  # word offsets of the documents, one more than documents
    bytes: np.ndarray  # byte offsets of the documents

    @property
    def rows(self) -> int:
        return len(self.docs) - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        up, down = _power_tables()
        at, n = 0, len(out)
        while at < n:
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + _HASH_BYTES, side="right")))
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            if e[-1] <= _HASH_BYTES:
                sums = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
                np.cumsum((self.data[base : base + int(e[-1])].astype(np.uint64) + np.uint64(1)) * up[: int(e[-1])], out=sums[1:])
                out[at:to] = (sums[e] - sums[s]) * down[s]
            for k in np.flatnonzero(e - s > _LONG_WORD):
                word = self.data[base + int(s[k]) : base + int(e[k])].tobytes()
                out[at + k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            at = to
        return mix(out)

    def text_of(self, row: int) -> bytes:
        return self.data[int(self.bytes[row]) : int(self.bytes[row + 1])].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Documents of a text column in blocks of about ``limit`` bytes."""
    raw, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        data = raw[int(offsets[at]) : int(offsets[to])]
        places = offsets[at : to + 1] - offsets[at]
        inside = _WORD_BYTE[data]
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            first = places[:-1][places[:-1] < len(data)]
            begin[first] = inside[first]
            last = places[1:][places[1:] > 0] - 1
            end[last] = inside[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Block(at, data, starts, ends, np.searchsorted(starts, places), places)
        at = to


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; shorter than ``words`` by size - 1."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mix(out)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def places_in_documents(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place in its document of each word, from word offsets."""
    counts = np.diff(docs)
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc, np.arange(int(docs[-1]) - int(docs[0])) - np.repeat(docs[:-1] - docs[0], counts)
