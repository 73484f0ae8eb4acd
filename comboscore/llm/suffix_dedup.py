"""Suffix-array deduplication: every byte of a string that occurs twice or more goes.

A byte is removed if a ``length``-byte string around it also starts anywhere else, in another
document or in the same one; matches never cross documents and are judged on the input.

1. Shards. Each window of ``length`` bytes is represented by the smallest hash of the
   ``SEED``-byte grams inside it, a function of the window's content, so equal windows meet
   under one gram. Neighbouring windows with one gram form a run. Runs whose gram occurs once
   are dropped; runs that are equal from end to end are counted and settled by a partial
   aggregate, and only one of them goes on. The others are dealt to shards of about
   ``SHARD`` bytes by gram. A gram with more than a shard's bytes is split over several.
2. In a shard, one suffix array over its strings by Larsson-Sadakane refinement in numpy:
   order by the first seven symbols, then double the compared length, sorting only groups
   that are not settled. Common prefixes by Kasai's rule (a prefix shrinks by one at most
   when the suffix moves by one), in many lanes side by side. A suffix whose neighbour shares
   ``length`` bytes or more is repeated.
3. Across the shards of a split gram, each shard hands on the sorted fingerprints (two
   64-bit hashes) of its distinct windows, cut into ranges; shards are merged range by range
   by binary search in one another's lists.

Every step is a partial aggregate, an equi-join (split by AQE when skewed) or a group of
bounded size. Defined results: a null text is empty; a text shorter than ``length`` is kept;
rows with one doc_id, or none, count as separate documents; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.llm.substring_dedup import _numbers, _rows, keyed
from comboscore.session import cut_lineage

SEED = 64
SHARD = 1 << 20
LANES = 1 << 13
RUNS = "gram long, content long, doc_id long, text_key long, lo int, hi int, inner int"
PIECES = "gram long, doc_id long, text_key long, n long, lo int, shards int, shard long, part int, piece binary"
FOUND = "doc_id long, text_key long, lo int, hi int, gram long, part int, fingerprints binary"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def byte_runs(length: int, seed: int):
    def run(batches):
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                n = len(data)
                if n < length:
                    continue
                h = C.prefix(data)
                at = np.arange(n - seed + 1)
                grams = C.between(h, at, at + seed)
                d, gram, lo, hi = C.runs_of_windows(grams, offsets, seed, length)
                content = C.between(h, lo, hi + length)
                inner = gram_repeats(grams, gram, lo, hi, length - seed + 1)
                yield _rows(RUNS, gram, content, _numbers(sub, "doc_id")[d] if not sub.column("doc_id").null_count
                            else sub.column("doc_id").take(pa.array(d)), _numbers(sub, "text_key")[d],
                            (lo - offsets[d]).astype(np.int32), (hi - offsets[d]).astype(np.int32), inner)
    return run


def gram_repeats(grams, gram, lo, hi, width: int) -> np.ndarray:
    """1 for a run that holds its gram twice or more (it may repeat a string in itself)."""
    least = C.sliding_min(grams, width)
    edge = np.zeros(width - 1, np.uint64)             # complement: the largest of the smallest
    top = ~C.sliding_min(np.concatenate([~edge, ~least, ~edge]), width)
    at = np.flatnonzero(top == grams)                 # positions that are smallest in a window
    a, b = np.searchsorted(at, lo), np.searchsorted(at, hi + width)
    run = np.repeat(np.arange(len(lo)), b - a)
    same = grams[at[C.ranges(a, b - a)]] == gram[run]
    return (np.bincount(run[same], minlength=len(lo)) > 1).astype(np.int32)


def cut_pieces(length: int):
    """The bytes of every listed run."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column("text")[k].as_buffer().to_pybytes()
                spans = batch.column("spans")[k].as_py()
                many = len(spans)
                row = [batch.column(c)[k].as_py() for c in ("doc_id", "text_key")]
                yield pa.record_batch(
                    [pa.array([s["gram"] for s in spans], pa.int64()), pa.array([row[0]] * many, pa.int64()),
                     pa.array([row[1]] * many, pa.int64()), pa.array([s["n"] for s in spans], pa.int64()),
                     pa.array([s["lo"] for s in spans], pa.int32()), pa.array([s["shards"] for s in spans], pa.int32()),
                     pa.array([s["shard"] for s in spans], pa.int64()), pa.array([s["part"] for s in spans], pa.int32()),
                     pa.array([raw[s["lo"]:s["hi"] + length] for s in spans], pa.binary())],
                    names=[x.split()[0] for x in PIECES.split(", ")])
    return run


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, each up to its string's end.

    ``data``: strings one after the other; ``left``: bytes from each position to the end of
    its string. Suffixes that agree to their ends keep their positions' order, so the order
    stays the same when all move on by one byte, as Kasai's rule needs.
    """
    n = len(data)
    first = np.zeros(n, np.uint64)
    for k in range(7):
        symbol = np.zeros(n, np.uint64)
        if k < n:
            symbol[:n - k] = data[k:].astype(np.uint64) + np.uint64(1)
        symbol[left <= k] = 0
        first = (first << np.uint64(9)) | symbol
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)

    def settle(places, new):
        """Number groups by their first place; give the places of groups that are not single."""
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order[places]] = places[heads][group]
        sizes = np.diff(np.append(heads, len(places)))
        return places[sizes[group] > 1]

    key = first[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    open_ = settle(np.arange(n), new)
    h = 7
    while len(open_):
        suffix = order[open_]
        more = left[suffix] > h                     # an ended suffix comes before longer ones
        key = rank[suffix] * (n + 1) + np.where(more, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[open_], key = suffix[by], key[by]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        open_ = settle(open_, new)
        open_ = open_[left[order[open_]] > h]       # groups that agree to their ends are done
        h *= 2
    return order


def common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For every position, the bytes (``cap`` at most) its suffix shares with the one before it in order."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + cap + 1]
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    out = np.zeros(n, np.int64)
    steps = -(-n // LANES)
    at = np.arange(0, n, steps)
    shared = np.zeros(len(at), np.int64)
    for _ in range(steps):
        live = np.flatnonzero(at < n)
        i = at[live]
        j = before[i]
        ok = j >= 0
        most = np.where(ok, np.minimum(np.minimum(left[i], left[j]), cap), 0)
        have = np.minimum(np.maximum(shared[live] - 1, 0), most)
        todo = np.flatnonzero(have < most)
        while len(todo):
            x = eight[i[todo] + have[todo]] ^ eight[j[todo] + have[todo]]
            same = x == 0
            low = x & (~x + np.uint64(1))                 # lowest bit that differs
            step = np.where(same, 8, np.log2(np.where(same, np.uint64(1), low).astype(np.float64)).astype(np.int64) >> 3)
            have[todo] = np.minimum(have[todo] + step, most[todo])
            todo = todo[same & (have[todo] < most[todo])]
        out[i] = have
        shared[live] = have
        at = at + 1
    return out


def repeated_windows(strings: list[bytes], length: int):
    """(data, piece, position in piece, flags, leaders) of the windows of a shard.

    Flags: the window occurs more than once; leaders: the first in order of its kind.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(strings)), sizes)
    left = ends[piece] - np.arange(len(data))
    order = suffix_array(data, left)
    shared = common_prefixes(data, left, order, length)
    same = np.zeros(len(data), bool)
    same[1:] = shared[order[1:]] >= length          # with the one before, in order
    twice = same.copy()
    twice[:-1] |= same[1:]
    flags, leaders = np.zeros(len(data), bool), np.zeros(len(data), bool)
    flags[order] = twice
    leaders[order] = ~same
    whole = left >= length
    return data, piece, np.arange(len(data)) - (ends - sizes)[piece], flags & whole, leaders & whole


def _spans(piece, position, flags):
    """Neighbouring flagged windows of one piece as (piece, first, last)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (piece[at[1:]] != piece[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return piece[at[first]], position[at[first]], position[at[last]]


def shard_search(length: int):
    """One shard: spans found inside it, and fingerprints for the other shards of split grams."""
    def run(key, table):
        t = table.combine_chunks()
        ids, texts, grams, n, lo, shards = (t.column(c).to_pylist() for c in
                                            ("doc_id", "text_key", "gram", "n", "lo", "shards"))
        strings = t.column("piece").to_pylist()
        data, piece, position, flags, leaders = repeated_windows(strings, length)
        out = [[], [], [], [], [], [], []]
        alone = np.array(n) == 1                      # the others are settled already
        for p, a, b in zip(*_spans(piece, position, flags & alone[piece])):
            for col, v in zip(out, (ids[p], texts[p], lo[p] + int(a), lo[p] + int(b), None, None, None)):
                col.append(v)
        split = np.array(shards)[piece] > 1
        pick = np.flatnonzero(leaders & split)
        if len(pick):
            h = C.prefix(data)
            one = C.between(h, pick, pick + length)
            half = length // 2
            with np.errstate(over="ignore"):
                two = C.mix(C.between(h, pick, pick + half) * np.uint64(3) + C.between(h, pick + half, pick + length))
            many = np.array(shards)[piece[pick]].astype(np.uint64)
            part = (one % many).astype(np.int64)
            gram = np.array(grams, np.int64)[piece[pick]]
            own = np.where(alone[piece[pick]], np.array(lo)[piece[pick]] + position[pick], -1)
            by = np.lexsort((one, part, gram))
            cut = np.flatnonzero(np.diff(gram[by]) | np.diff(part[by])) + 1
            for rows in np.split(by, cut):
                docs = [ids[p] for p in piece[pick[rows]]]
                keys = [texts[p] for p in piece[pick[rows]]]
                # one Arrow message: sorted fingerprints with their places
                sink = pa.BufferOutputStream()
                rb = pa.record_batch([pa.array(one[rows]), pa.array(two[rows]), pa.array(docs, pa.int64()),
                                      pa.array(keys, pa.int64()), pa.array(own[rows], pa.int64())],
                                     names=["one", "two", "doc_id", "text_key", "at"])
                with pa.ipc.new_stream(sink, rb.schema) as w:
                    w.write_batch(rb)
                for col, v in zip(out, (None, None, None, None, int(gram[rows[0]]), int(part[rows[0]]),
                                        sink.getvalue().to_pybytes())):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])
    return run


def merge_shards(key, table):
    """Windows of one range of a split gram that another shard has too, by binary search."""
    lists = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("fingerprints")]
    out_id, out_key, out_at = [], [], []
    sorted_ = [(x["one"].to_numpy(), x["two"].to_numpy()) for x in lists]
    for k, mine in enumerate(lists):
        one, two = sorted_[k]
        hit = np.zeros(len(one), bool)
        for other, (a, b) in enumerate(sorted_):
            if other == k or not len(a):
                continue
            p = np.minimum(np.searchsorted(a, one), len(a) - 1)
            hit |= (a[p] == one) & (b[p] == two)
        at = mine["at"].to_numpy()
        pick = np.flatnonzero(hit & (at >= 0))
        out_id += mine["doc_id"].take(pa.array(pick)).to_pylist()
        out_key += mine["text_key"].take(pa.array(pick)).to_pylist()
        out_at += at[pick].tolist()
    return pa.table([pa.array(out_id, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out_at, pa.int32()),
                     pa.array(out_at, pa.int32())], names=["doc_id", "text_key", "lo", "hi"])


def kept_bytes(length: int):
    def run(batches):
        for batch in batches:
            size, gone, many, kept = [], [], [], []
            offsets, data = C.utf8(batch.column("text"))
            spans = batch.column("spans")
            for k in range(batch.num_rows):
                own = data[offsets[k]:offsets[k + 1]]
                size.append(len(own))
                if spans[k].is_valid and len(spans[k]):
                    f = spans[k].values
                    lo, hi = (f.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(2))
                    removed = C.covered(lo, hi + length, len(own))
                    gone.append(int(removed.sum()))
                    many.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
                    own = own[~removed]
                else:
                    gone.append(0)
                    many.append(0)
                kept.append(own.tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                                   pa.array(many, pa.int64()), pa.array(kept, pa.binary())],
                                  names=[x.split()[0] for x in KEPT.split(", ")])
    return run


def repeated_spans(docs: DataFrame, length: int = 400, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(doc_id, text_key, lo, hi): first and last start of neighbouring repeated strings."""
    runs = docs.mapInArrow(byte_runs(length, seed), RUNS)
    repeated = (runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"))
                .where("n > 1 or inner > 0").select("gram"))
    live = cut_lineage(runs.join(repeated, "gram"))
    kinds = live.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"),
                                                F.min(F.struct("doc_id", "text_key", "lo", "hi", "inner")).alias("one"))
    whole = (live.join(kinds.where("n > 1").select("gram", "content"), ["gram", "content"])
             .select("doc_id", "text_key", "lo", "hi"))
    bytes_ = F.col("one.hi") - F.col("one.lo") + length
    grams = (kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(bytes_).alias("bytes"),
                                       F.max("one.inner").alias("inner"))
             .where("kinds > 1 or inner > 0"))
    grams = cut_lineage(grams.select("gram", F.ceil(F.col("bytes") / shard).cast("int").alias("shards"), "bytes"))
    total = grams.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-int(total) // shard))
    placed = (kinds.join(grams, "gram")
              .select("gram", "n", "one.*", "shards", F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("shard"),
                      F.pmod(F.col("content"), F.col("shards")).cast("int").alias("part")))
    # a split gram has shards of its own
    placed = placed.withColumn("shard", F.when(F.col("shards") > 1, F.xxhash64("gram", "part")).otherwise(F.col("shard")))
    per_doc = placed.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("gram", "n", "lo", "hi", "shards", "shard", "part")).alias("spans"))
    key = [docs["text_key"] == per_doc["text_key"], docs["doc_id"].eqNullSafe(per_doc["doc_id"])]
    pieces = (docs.join(per_doc, key).select(docs["doc_id"], docs["text_key"], "text", "spans")
              .mapInArrow(cut_pieces(length), PIECES))
    found = cut_lineage(pieces.groupBy("shard", "part").applyInArrow(shard_search(length), FOUND))
    inside = found.where("fingerprints is null").select("doc_id", "text_key", "lo", "hi")
    across = (found.where("fingerprints is not null").select("gram", "part", "fingerprints")
              .groupBy("gram", "part").applyInArrow(merge_shards, "doc_id long, text_key long, lo int, hi int"))
    return whole.unionByName(inside).unionByName(across)


def drop_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                        shard: int = SHARD) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes)."""
    docs = keyed(docs, id_col, text_col)
    spans = (repeated_spans(docs, length, shard=shard).groupBy("doc_id", "text_key")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    key = [docs["text_key"] == spans["text_key"], docs["doc_id"].eqNullSafe(spans["doc_id"])]
    out = docs.join(spans, key, "left").select(docs["doc_id"], "text", "spans")
    return out.mapInArrow(kept_bytes(length), KEPT)
