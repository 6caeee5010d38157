"""Vectorised scanning of Arrow text columns: words, word hashes and word n-grams of many documents at once.

A text column is cut into chunks of whole documents of about CHUNK bytes, so that the memory of a task does not depend on
the size of its partition. A single longer document is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
MOST_DOCS = 1 << 15
SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _codes(mapped: bytes) -> np.ndarray:
    """A 64-bit code per byte value after mapping; 0 marks bytes that are not part of a word."""
    values = np.frombuffer(mapped, np.uint8).astype(np.uint64)
    codes = mix(values + np.uint64(0x1234567)) | np.uint64(1)
    codes[np.frombuffer(mapped, np.uint8) == 32] = 0
    return codes


def _mapping(separators: bytes) -> bytes:
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    for b in separators:
        table[b] = 32
    return bytes(table)


#: Lower-cased A-Z; words are runs of anything but ASCII white space.
SPACED = _mapping(b" \t\n\x0b\x0c\r")
#: Lower-cased A-Z; words are runs of digits, letters and bytes outside ASCII.
ALNUM = _mapping(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
CODES = {SPACED: _codes(SPACED), ALNUM: _codes(ALNUM)}
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for later calls and doubled when more are asked for.

    They are made where they are used: a function sent to executors takes its module's tables along.
    """
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 2 * len(_POWERS.get("p", ())), 256)
        with np.errstate(over="ignore"):
            for name, base in (("p", int(_BASE)), ("i", pow(int(_BASE), -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["p"], _POWERS["i"]


class Chunk:
    """Whole documents in one byte buffer; `first` is the row of the batch that document 0 comes from."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets
        self.docs = len(offsets) - 1

    def text(self, doc: int) -> bytes:
        return self.buf[self.offsets[doc] : self.offsets[doc + 1]].tobytes()


def give_back() -> None:
    """Return freed memory to the system: a worker process serves many tasks, and what one has freed would count for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of the column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    give_back()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data = column.buffers()
    offsets = np.frombuffer(data[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data[2], np.uint8) if data[2] is not None and data[2].size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, row + MOST_DOCS)
        yield Chunk(row, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Words:
    """Words of a chunk: byte starts and ends, and `first[d]` .. `first[d + 1]` as the words of document d."""

    def __init__(self, chunk: Chunk, mapping: bytes = SPACED):
        codes, buf, n = CODES[mapping], chunk.buf, len(chunk.buf)
        inside = (codes != 0)[buf]
        fresh = np.zeros(n + 1, bool)
        fresh[chunk.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before &= ~fresh[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after &= ~fresh[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, chunk.offsets)
        self.chunk, self.codes, self.mapping = chunk, codes, mapping

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.docs), self.counts())

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """A 64-bit hash per word (or of its first `prefix` bytes), from running sums over at most SEGMENT bytes at a time."""
        out, i = np.empty(len(self), np.uint64), 0
        while i < len(self):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + SEGMENT, "right")))
            power, inverse = powers(int(self.ends[j - 1] - at) + 1)
            part = self.codes[self.chunk.buf[at : self.ends[j - 1]]]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            e = np.minimum(e, s + prefix) if prefix else e
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _M3)
            i = j
        return out

    def ngrams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they all lie in its document."""
        total = len(hashes)
        if total < n:
            return np.zeros(total, np.uint64), np.zeros(total, bool)
        size = total - n + 1
        out = hashes[:size].copy()
        for j in range(1, n):
            out = mix(out * _M3 + hashes[j : j + size])
        full = np.zeros(total, np.uint64)
        full[:size] = out
        left = np.repeat(self.first[1:], self.counts()) - np.arange(total)
        return full, left >= n

    def span(self, i: int, n: int) -> bytes:
        """The n words from word i on, mapped, joined by one space."""
        return b" ".join(self.chunk.buf[self.starts[i] : self.ends[i + n - 1]].tobytes().translate(self.mapping).split())
