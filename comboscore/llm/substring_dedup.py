"""Substring deduplication: word sequences that already start in an earlier document go.

Level-wise doubling. A window of ``window`` words can only repeat if its parts of half the
length repeat, so short sequences are tested first and only those that repeat are extended
to twice their length:

* level 1 (``window`` / 2 words): every window is represented by the smallest hash of the
  half-length grams inside it. That gram is chosen by the window's content alone, so equal
  windows share it, and about two in ``window`` / 2 positions are chosen instead of all.
  Neighbouring windows with one representative form a run; a run whose gram starts in one
  document only is dropped.
* level 2 (``window`` words): surviving runs that read the same from end to end are settled
  together (the smallest document keeps them, later ones lose them). Where the surrounding
  words differ, the run's windows are hashed one by one and compared.
* No window longer than ``window`` decides anything (a longer repeat is covered by its
  windows), so no candidates survive level 2 and the doubling stops.

Hot groups: every grouping is a partial aggregate (one row per key and map task is
shuffled) followed by an equi-join, which AQE splits when skewed; no group is collected.
Repeats are settled by (gram, content) pairs of independent 64-bit hashes.

Defined results: a null text has no words; a null doc_id is never earlier or later than
another document, so such rows are kept whole; rows that share a doc_id never remove words
from each other; texts shorter than a window are kept; other input columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.session import cut_lineage

RUNS = "gram long, content long, doc_id long, text_key long, lo int, hi int"
WINDOWS = "gram long, content long, doc_id long, text_key long, lo int, hi int"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _rows(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return pa.record_batch([pa.array(c.view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c, t)
                            for c, t in zip(columns, types)], names=names)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def word_runs(window: int):
    """Runs of windows with one smallest half-length gram, for each document."""
    half = max(1, window // 2)

    def run(batches):
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                w = C.Words(offsets, data)
                n = len(w)
                if n < window:
                    continue
                h = C.word_prefix(w.hashes)
                at = np.arange(n - half + 1)
                d, gram, lo, hi = C.runs_of_windows(C.word_span(h, at, at + half), w.bounds, half, window)
                content = C.word_span(h, lo, hi + window)
                base = w.bounds[d]
                yield _rows(RUNS, gram, content, _numbers(sub, "doc_id")[d], _numbers(sub, "text_key")[d],
                            (lo - base).astype(np.int32), (hi - base).astype(np.int32))
    return run


def run_windows(window: int):
    """Every window of the runs listed in ``spans`` (structs of gram, lo, hi)."""
    def run(batches):
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                w = C.Words(offsets, data)
                h = C.word_prefix(w.hashes)
                spans = sub.column("spans")
                per_doc = np.diff(spans.offsets.to_numpy())
                flat = spans.flatten()
                gram, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                d = np.repeat(np.arange(len(per_doc)), per_doc)
                many = (hi - lo + 1).astype(np.int64)
                at = C.ranges(lo, many)
                of = np.repeat(np.arange(len(gram)), many)
                pos = at + w.bounds[d[of]]
                yield _rows(WINDOWS, gram[of], C.word_span(h, pos, pos + window), _numbers(sub, "doc_id")[d[of]],
                            _numbers(sub, "text_key")[d[of]], at.astype(np.int32), at.astype(np.int32))
    return run


def kept_words(window: int):
    """Documents without the words covered by their removed windows; one mask over the bytes of many
    documents, no loop over words."""
    def run(batches):
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                w = C.Words(offsets, data, hashed=False)
                spans = sub.column("spans")
                per_doc = np.diff(spans.offsets.to_numpy())
                per_doc[spans.is_null().to_numpy(zero_copy_only=False)] = 0
                flat = spans.flatten()
                lo, hi = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(2))
                base = np.repeat(w.bounds[:-1], per_doc)
                removed = C.covered(lo + base, hi + base + window, len(w))
                kept = np.flatnonzero(~removed)
                document = w.documents()
                more = np.zeros(len(kept), bool)          # another kept word of the document follows
                more[:-1] = document[kept[1:]] == document[kept[:-1]]
                start, end = w.starts[kept], w.ends[kept]
                # between two words of a document stands a separator at least: the first becomes the blank
                out = data.copy()
                out[end[more]] = 0x20
                keep = C.covered(start, end + more, len(data))
                ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
                text = pa.Array.from_buffers(pa.large_string(), sub.num_rows, [None, pa.py_buffer(ends.astype(np.int64)),
                                                                               pa.py_buffer(out[keep])])
                gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[w.bounds])
                yield pa.record_batch([sub.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(gone, pa.int64()),
                                       text.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text: rows that share a doc_id stay apart by it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("text_key"))


def removed_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, spans): first and last window start of every removed stretch."""
    docs = docs.where(F.col("doc_id").isNotNull())
    runs = docs.mapInArrow(word_runs(window), RUNS)
    repeated = (runs.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                .where("a < b").select("gram"))
    live = cut_lineage(runs.join(repeated, "gram"))
    settled = live.groupBy("gram", "content").agg(F.min("doc_id").alias("first_id"))
    mixed = settled.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    live = live.join(settled, ["gram", "content"])
    whole = live.where("doc_id > first_id").select("doc_id", "text_key", "lo", "hi")
    open_runs = (live.where("doc_id = first_id").join(mixed, "gram")
                 .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "lo", "hi")).alias("spans")))
    windows = docs.join(open_runs, ["doc_id", "text_key"]).mapInArrow(run_windows(window), WINDOWS)
    first = (windows.groupBy("gram", "content").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
             .where("a < b").select("gram", "content", F.col("a").alias("first_id")))
    late = (windows.join(first, ["gram", "content"]).where("doc_id > first_id")
            .select("doc_id", "text_key", "lo", "hi"))
    return (whole.unionByName(late).groupBy("doc_id", "text_key")
            .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def drop_repeated_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words, one blank between)."""
    docs = keyed(docs, id_col, text_col)
    spans = removed_spans(docs, window)
    return docs.join(spans, ["doc_id", "text_key"], "left").mapInArrow(kept_words(window), KEPT)
