"""Best-fit-decreasing packing of token sequences.

A document's ids are first cut into full windows; the rests, longest first, each go to the
open window with the least room that still holds them. A segment tree over room sizes
(1..``size``) finds that window in log2(size) steps.

Packing runs inside the tasks that tokenise: a task collects at most ``BATCH`` ids, packs
them, and goes on, so nothing is shuffled and memory is bounded. Sequence numbers are
(partition << 33) + a running number, so they are unique and the same when a task is run
again. Only the last windows of a batch hold padding.

Defined results: a null or empty text has its closing id only; rows with one doc_id are
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.llm.tokens import Encoder

SIZE = 2048
END = 1
BATCH = 4 << 20
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Rooms:
    """Open windows by remaining room; a segment tree counts the windows under each node."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._add(room, 1)

    def take(self, need: int):
        """(room, window) with the least room of at least ``need``; None if there is none."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):      # up to the next subtree on the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: np.ndarray, size: int = SIZE):
    """Place documents of ``lengths`` (1 or more ids each).

    Returns (document, start in document, length, window, offset in window), one entry per
    piece, and the number of windows.
    """
    lengths = np.asarray(lengths, np.int64)
    full, rest = lengths // size, lengths % size
    doc = np.repeat(np.arange(len(lengths)), full)
    start = C.ranges(np.zeros(len(lengths), np.int64), full) * size
    window = np.arange(len(doc))
    n = len(doc)
    tails = np.flatnonzero(rest)
    tails = tails[np.argsort(-rest[tails], kind="stable")]
    rooms, at, offset = Rooms(size), [], []
    for need in rest[tails].tolist():
        found = rooms.take(need)
        room, w = found or (size, n)
        n += found is None
        at.append(w)
        offset.append(size - room)
        rooms.put(room - need, w)
    tail_start = full[tails] * size
    return (np.concatenate([doc, tails]), np.concatenate([start, tail_start]),
            np.concatenate([np.full(len(doc), size, np.int64), rest[tails]]),
            np.concatenate([window, np.array(at, np.int64)]),
            np.concatenate([np.zeros(len(doc), np.int64), np.array(offset, np.int64)]), n)


def batches_of_ids(batches, path, end, limit):
    """(doc_ids, ids, ids per document) of at most about ``limit`` ids, one document at least."""
    encoder = Encoder(path)
    names, ids, sizes, held = [], [], [], 0
    for batch in batches:
        for sub, offsets, data in C.parts(batch):
            flat, many = encoder.encode(offsets, data, end)
            names += sub.column("doc_id").to_pylist()
            ids.append(flat)
            sizes.append(many)
            held += len(flat)
            if held >= limit:
                yield names, np.concatenate(ids), np.concatenate(sizes)
                names, ids, sizes, held = [], [], [], 0
    if names:
        yield names, np.concatenate(ids), np.concatenate(sizes)


def pack_pieces(size: int, path, end: int, limit: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for names, ids, many in batches_of_ids(batches, path, end, limit):
            doc, start, length, window, offset, n = best_fit(many, size)
            begin = np.cumsum(many) - many
            raw = memoryview(ids.astype("<u4").tobytes())
            lo = (begin[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + length * 4).tolist())]
            yield pa.record_batch([pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(many[doc], pa.int64()),
                                   pa.array(window + base, pa.int64()), pa.array(offset, pa.int64())],
                                  names=[x.split()[0] for x in PIECES.split(", ")])
            base += n
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end: int = END, limit: int = BATCH,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return _texts(docs, id_col, text_col).mapInArrow(pack_pieces(size, vocabulary, end, limit), PIECES)
