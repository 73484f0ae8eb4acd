"""Vectorised text primitives on Arrow batches: word spans, word and window hashes.

Python workers receive texts as Arrow buffers. Everything here works on the raw UTF-8 bytes
of many documents at once with numpy, so no Python loop runs per word. Both separators used
by the operators are ASCII, so byte positions decide word limits exactly.

Memory is bounded by ``CHUNK`` bytes of text at a time (a longer document is one chunk).
Hashes are 64-bit: a polynomial over the bytes (or over the word hashes), finished with a
mixing step. Operators that must be exact pair two independent hashes or compare contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64

_P = U64(0x9E3779B97F4A7C15)          # odd multipliers, so each has an inverse modulo 2**64
_Q = U64(0xD1342543DE82EF95)


def _inverse(p: np.uint64) -> np.uint64:
    return U64(pow(int(p), -1, 1 << 64))


class _Powers:
    """p**i and p**-i modulo 2**64, grown on demand."""

    def __init__(self, p):
        self.p, self.q = p, _inverse(p)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, x, U64)]), dtype=U64)
                                  for x in (self.p, self.q))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (every input bit reaches every output bit)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def table(separators) -> np.ndarray:
    """256 flags: True where a byte belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


# white space: blank and 0x09-0x0D
SPACE_WORDS = table([0x20, *range(0x09, 0x0E)])
# letters, digits and everything beyond ASCII
ALNUM_WORDS = table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is the empty text."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    if a.null_count:
        a = a.fill_null("")
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    buffers = a.buffers()
    if len(a) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], kind)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """(sub-batch, offsets, bytes) in chunks."""
    offsets, data = utf8(batch.column(column))
    for i, j in chunks(offsets, limit):
        o = offsets[i:j + 1] - offsets[i]
        yield batch.slice(i, j - i), o, data[offsets[i]:offsets[j]]


class Words:
    """Words of a chunk of documents.

    starts, ends: byte positions in the chunk; bounds: word index at which each document
    begins (documents + 1 values); hashes: 64-bit word hashes.
    """

    def __init__(self, offsets, data, is_word=SPACE_WORDS, lower=False, hashed=True):
        self.offsets = offsets
        if lower:
            data = LOWER[data]
        self.data = data
        inside = is_word[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        if n:
            before = np.empty(n, bool)
            before[0] = False
            before[1:] = inside[:-1]
            self.starts = np.flatnonzero(inside & (~before | first[:n]))
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = inside[1:]
            self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends) if hashed else None

    def __len__(self):
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def prefix(data: np.ndarray, powers=_BYTES) -> np.ndarray:
    """h with h[j] - h[i] = hash of data[i:j] times p**i."""
    up, _ = powers.get(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=h[1:])
    return h


def between(h: np.ndarray, i, j, powers=_BYTES) -> np.ndarray:
    """Hash of each range i:j from prefix sums ``h``."""
    _, down = powers.get(len(h))
    with np.errstate(over="ignore"):
        return mix((h[j] - h[i]) * down[i] + (np.asarray(j) - np.asarray(i)).astype(U64))


def span_hashes(data, starts, ends) -> np.ndarray:
    return between(prefix(data), starts, ends)


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    return prefix(hashes, _WORDS)


def word_span(h: np.ndarray, i, j) -> np.ndarray:
    """Hash of the word sequence i:j from ``word_prefix``."""
    return between(h, i, j, _WORDS)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (len(a) - width + 1 values), by doubling."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    span, b = 1, a
    while span * 2 <= width:
        b = np.minimum(b[:-span], b[span:])
        span *= 2
    return np.minimum(b[:n], b[width - span:width - span + n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated arange(s, s + c) for every pair."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.repeat(np.asarray(starts, np.int64) - at, counts) + np.arange(total)


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Flags of 0..n-1 that lie in one of the ranges lo:hi."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.clip(lo, 0, n), 1)
    np.add.at(d, np.clip(hi, 0, n), -1)
    return np.cumsum(d[:n]) > 0


def runs_of_windows(values: np.ndarray, bounds: np.ndarray, span: int, width: int):
    """Runs of neighbouring windows with one smallest gram.

    ``values`` are gram hashes at every unit position (each gram spans ``span`` units, the
    tail may hold fewer and is not read), ``bounds`` the unit index at which each document
    begins, ``width`` the window's units. Every window is represented by the smallest hash
    of the grams inside it, which depends on the window's content alone. Windows that start
    side by side with the same smallest gram form a run. Returns (document, smallest, first
    window, last window), positions relative to the chunk.
    """
    total = int(bounds[-1])
    if total < width:
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z, z
    least = sliding_min(values[:total - span + 1], width - span + 1)
    n = len(least)
    documents = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = documents[:n] == documents[width - 1:width - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (documents[1:n] != documents[:n - 1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    if not len(first):
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z, z
    stop = np.flatnonzero(new | ~valid)
    stop = np.append(stop, n)
    last = stop[np.searchsorted(stop, first, "right")] - 1
    return documents[first], least[first], first, last
