"""Packed token-id matrices for training, as binary columns.

Documents are tokenised, cut losslessly into full windows, and their rests are placed by
best-fit decreasing with the segment tree of ``packing``. One row is one window of the packed
matrix:

* ``input_ids``: ``size`` little-endian unsigned ids, padded with ``pad``;
* ``position_ids``: as many positions that restart at 0 in every segment (0 in the padding);
* ``cu_seqlens``: cumulative segment lengths, 0 first, the number of real ids last;
* ``doc_ids``, ``starts``: each segment's document and its place there, so every document
  can be put together again.

Ids take two bytes while the vocabulary allows it, else four. Rows are made inside the tasks
that tokenise (no shuffle); at most about ``limit`` ids are held. ``write_packed`` writes them
as Parquet, ``read_packed`` reads them back as documents. Null texts, repeated rows and empty
tables: see ``packing``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.llm import packing as P

ROWS = ("sequence_id long, input_ids binary, position_ids binary, cu_seqlens array<int>, "
        "doc_ids array<long>, starts array<long>")
STEP = 512                                     # windows in one Arrow batch


def _list(at, values, i, j):
    return pa.ListArray.from_arrays(pa.array((at[i:j + 1] - at[i]).astype(np.int32)), values.slice(at[i], at[j] - at[i]))


def pack_windows(size: int, path, end: int, pad: int, width: int, limit: int):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for names, ids, many in P.batches_of_ids(batches, path, end, limit):
            doc, start, length, window, offset, n = P.best_fit(many, size)
            by = np.lexsort((offset, window))
            doc, start, length, window, offset = (x[by] for x in (doc, start, length, window, offset))
            begin = np.cumsum(many) - many
            pieces = np.bincount(window, minlength=n)
            at = np.concatenate([[0], np.cumsum(pieces)])
            # 0, then each segment's end, anew in every window
            cu = pa.array(np.insert(offset + length, at[:-1], 0).astype(np.int32))
            docs, starts = pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(start, pa.int64())
            for i in range(0, n, STEP):
                j = min(n, i + STEP)
                part = slice(at[i], at[j])
                place = C.ranges((window[part] - i) * size + offset[part], length[part])
                block, position = np.full((j - i) * size, pad, kind), np.zeros((j - i) * size, kind)
                block[place] = ids[C.ranges(begin[doc[part]] + start[part], length[part])]
                position[place] = C.ranges(np.zeros(at[j] - at[i], np.int64), length[part])
                rows = [pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(
                    (np.arange(j - i + 1) * size * width).astype(np.int32)), pa.py_buffer(x)]) for x in (block, position)]
                yield pa.record_batch([pa.array(np.arange(i, j) + base, pa.int64()), *rows,
                                       _list(at + np.arange(n + 1), cu, i, j), _list(at, docs, i, j), _list(at, starts, i, j)],
                                      names=[x.split()[0] for x in ROWS.split(", ")])
            base += n
    return run


def pack_ids(docs: DataFrame, size: int = P.SIZE, vocabulary: str | None = None, end: int = P.END, pad: int = 0,
             width: int = 2, limit: int = P.BATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed window; ``width``: bytes per id."""
    return P._texts(docs, id_col, text_col).mapInArrow(pack_windows(size, vocabulary, end, pad, width, limit), ROWS)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    pack_ids(docs, **options).write.parquet(path)


def _segments(width: int):
    kind = "<u2" if width == 2 else "<u4"

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for row in batch.select(["input_ids", "cu_seqlens", "doc_ids", "starts"]).to_pylist():
                ids, cu = np.frombuffer(row["input_ids"], kind), row["cu_seqlens"]
                for a, b, d, s in zip(cu, cu[1:], row["doc_ids"], row["starts"]):
                    for col, v in zip(out, (d, s, ids[a:b].tolist())):
                        col.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                   pa.array(out[2], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])
    return run


def read_packed(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, ids) of every document of a written matrix (ids that are unique per document)."""
    parts = spark.read.parquet(path).mapInArrow(_segments(width), "doc_id long, start long, ids array<int>")
    return (parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("s"))
            .select("doc_id", F.flatten(F.col("s.ids")).alias("ids")))
