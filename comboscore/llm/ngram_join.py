"""N-gram Jaccard join: all documents whose shingle sets overlap by ``threshold`` or more, as classes.

The overlap counts are a product of the sparse document by n-gram incidence with its own
transpose, done in blocks, after rows and columns that cannot matter are left out:

1. Rows. Documents with one shingle set are one row ("node"); its members follow it.
2. Columns. Two sets that link differ in D = (1 - threshold) / (1 + threshold) * (n1 + n2) shingles
   at most. Every set is dealt by hash into parts, as many for all sets of a class of sizes, and a
   set's parts that the other lacks are D at most, so they share one of the first D + 1 parts of
   each, under any common order (a set also takes the parts of the class below, if it can link
   with a set there). The order is rare first, a part being as rare as its rarest shingle by a count sketch of all
   shingles of all documents (fixed size, 2**``WIDTH`` counters; it decides the order only, never a
   result). A part is several shingles, so sets that share one by chance do not meet, also where the sketch is
   full and tells little. Sets of too few parts meet by single shingles as well, the first
   n - ceil(threshold * n) + 1 of each.
3. Blocks. Nodes that share such a part and are not kept apart by size (a set of fewer than
   ``threshold`` times the other's shingles cannot link) fall into one candidate class. Classes of
   more than one tile go through step 2 again, each for itself, by a sketch of their own shingles,
   until that saves no more. Each class is then cut into tiles of a bounded number of nodes and of shingles, and every pair of its tiles is
   one task: whole sets, overlap counts accumulated over rows whose sizes allow a link (a column
   of few rows adds one to each of its pairs; columns of many rows, whose blocks are dense, go by
   matrix products), and pairs below the size-derived bound
   threshold / (1 + threshold) * (n1 + n2) discarded. A task returns a star per linked group,
   never its pairs.
4. Links are joined to classes by ``components``.

Hot parts (by the sketch) are salted by node, the more the hotter, so that about ``HOT``
postings share a salt at any size of the table, and joined again in a second step. Sizes are
compared in whole numbers, so the threshold is met exactly. Shingles are 64-bit hashes of
their words, nodes 64-bit hashes of sets paired with their sizes.

Defined results: null or empty texts have no shingles and link with nothing; a text of fewer
than ``n`` words is one shingle; rows with one doc_id stay separate rows; a null doc_id is
never the smallest; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.llm.components import components
from comboscore.llm.substring_dedup import _numbers, keyed
from comboscore.session import cut_lineage

WIDTH, SLICE = 22, 16                        # counters of the sketch, and of a slice of it (powers of two)
HOT = 2048                                   # postings of a hot shingle that share a salt
TILE_NODES, TILE_SHINGLES = 1024, 1 << 21
COLUMNS = 2048
LIGHT, PAIRS = 64, 1 << 22                   # rows of a column that is multiplied pair by pair; pairs held at once

FIRST = "doc_id long, text_key long, n long, node long, slice int, counts binary"
POSTINGS = "shingle long, node long, n long, salt int"
EDGES = "a long, b long, shingle long, node long, lo long, hi long"
SETS = "node long, root long, tiles int, shingles binary"
SLICES = "slice int, counts binary"
SAVED = 0.5                                  # a round that leaves more than this share of the copies is the last
SEEN = 1 << 20                               # nodes a task remembers before it starts anew


def shingle_sets(w: C.Words, n: int):
    """(document, hash) of the distinct shingles of each document, sorted by both; counts per document."""
    counts = w.counts
    h = C.word_prefix(w.hashes)
    whole = np.flatnonzero(counts >= n)
    many = counts[whole] - n + 1
    at = C.ranges(w.bounds[whole], many)
    short = np.flatnonzero((counts > 0) & (counts < n))
    d = np.concatenate([np.repeat(whole, many), short])
    s = np.concatenate([C.word_span(h, at, at + n), C.word_span(h, w.bounds[short], w.bounds[short + 1])])
    by = np.argsort(s)
    by = by[np.argsort(d[by].astype(np.uint16) if len(counts) < 65536 else d[by], kind="stable")]
    d, s = d[by], s[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    d, s = d[new], s[new]
    return d, s, np.bincount(d, minlength=len(counts)), h


def node_ids(d, s, sizes):
    """A 64-bit hash of every set."""
    with np.errstate(over="ignore"):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return C.mix((upto[at[1:]] - upto[at[:-1]]) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def within(d, s, root):
    """Shingles named anew in each class, sorted by document and name: classes share none."""
    s = C.mix(s ^ C.mix(root.view(np.uint64))[d])
    by = np.lexsort((s, d))
    return d[by], s[by]


def add_counts(counts, s):
    at, many = np.unique(s >> np.uint64(64 - WIDTH), return_counts=True)
    counts[at] += many.astype(np.uint32)


def slices(counts):
    """Numbers and compressed counters of the slices that are not empty."""
    codec = pa.Codec("zstd")
    full = [k for k in range(1 << (WIDTH - SLICE)) if counts[k << SLICE:(k + 1) << SLICE].any()]
    blobs = [codec.compress(counts[k << SLICE:(k + 1) << SLICE].tobytes(), asbytes=True) for k in full]
    return pa.array(full, pa.int32()), pa.array(blobs, pa.binary())


def describe(n: int):
    """One row per document (size and node), then this task's part of the sketch in slices."""
    def run(batches):
        counts = np.zeros(1 << WIDTH, np.uint32)
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                d, s, sizes, _ = shingle_sets(C.Words(offsets, data, lower=True), n)
                add_counts(counts, s)
                rows = sub.num_rows
                yield pa.record_batch([sub.column("doc_id"), sub.column("text_key"), pa.array(sizes, pa.int64()),
                                       pa.array(node_ids(d, s, sizes).view(np.int64)), pa.nulls(rows, pa.int32()),
                                       pa.nulls(rows, pa.binary())], names=[x.split()[0] for x in FIRST.split(", ")])
        full, blobs = slices(counts)
        if len(full):
            none = pa.nulls(len(full), pa.int64())
            yield pa.record_batch([none, none, none, none, full, blobs], names=[x.split()[0] for x in FIRST.split(", ")])
    return run


def count_classes(n: int):
    """This task's part of the sketch of shingles named anew in each class."""
    def run(batches):
        counts = np.zeros(1 << WIDTH, np.uint32)
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                d, s, _, _ = shingle_sets(C.Words(offsets, data, lower=True), n)
                add_counts(counts, within(d, s, _numbers(sub, "root"))[1])
        full, blobs = slices(counts)
        if len(full):
            yield pa.record_batch([full, blobs], names=[x.split()[0] for x in SLICES.split(", ")])
    return run


def add_slices(key, table):
    codec, total = pa.Codec("zstd"), np.zeros(1 << SLICE, np.uint64)
    for blob in table.column("counts"):
        raw = codec.decompress(blob.as_buffer(), decompressed_size=4 << SLICE, asbytes=True)
        total += np.frombuffer(raw, np.uint32)
    # eight levels per doubling: one byte a counter
    level = np.minimum(255, np.log2(total.astype(float) + 1) * 8).astype(np.uint8)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])


def size_classes(sizes, up: int, low: int):
    """First sizes of the classes, and each set's class. A set links with its own class and the two next to it only."""
    begin = [1]
    while begin[-1] <= sizes.max(initial=0):
        begin.append(max(begin[-1] + 1, 3 * begin[-1] // 2, -(-begin[-1] * low // up)))
    begin = np.array(begin, np.int64)
    k = np.maximum(np.searchsorted(begin, sizes, "right") - 1, 0)
    return begin, k


def set_parts(d, s, level, first, last, up: int, low: int):
    """(document, hash, level) of the parts of all sets, by document; ``first``, ``last``: sizes of a document's class.

    Five parts for every four shingles in which the longest sets of the class may differ: enough that
    few sets have no part to spare, and the most common parts are left out.
    """
    many = np.maximum(1, -(-5 * last * (low - up) // (4 * up)))
    named = C.mix(first.astype(np.uint64))
    part = ((C.mix(s ^ named[d]) >> np.uint64(32)) * many[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    cell = (np.cumsum(many) - many)[d] + part
    by = np.argsort(cell, kind="stable")
    cell = cell[by]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]]))
    if not len(start):
        return d[:0], s[:0], level[:0]
    who = d[by[start]]
    with np.errstate(over="ignore"):
        content = np.add.reduceat(C.mix(s[by]), start)
        return who, C.mix(content ^ C.mix(part[by[start]].astype(np.uint64) + named[who])), np.minimum.reduceat(level[by], start)


def firsts(who, s, level, want):
    """Places of the first ``want`` of each document's rows, rare ones first."""
    by = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
    by = by[np.argsort(who[by], kind="stable")]
    have = np.bincount(who, minlength=len(want))
    return by[C.ranges(np.cumsum(have) - have, np.minimum(have, want))]


def signatures(d, s, level, sizes, up: int, low: int):
    """(document, hash, level): two sets that link share a hash."""
    begin, k = size_classes(sizes, up, low)
    below = np.maximum(k - 1, 0)
    short = np.zeros(len(sizes), bool)
    out = []
    # each set in its own class, whose partners may be larger, then in the class below, whose sets are smaller
    for of, partner, ok in ((k, sizes * low // up, sizes > 0), (below, begin[k] - 1, (k > 0) & ((begin[k] - 1) * low >= sizes * up))):
        differ = (sizes + partner) * (low - up) // (low + up)
        mine = ok[d]
        who, part, rare = set_parts(d[mine], s[mine], level[mine], begin[of], begin[np.minimum(of + 1, len(begin) - 1)] - 1, up, low)
        at = firsts(who, part, rare, np.where(ok, differ + 1, 0))
        out.append((who[at], part[at], rare[at]))
        short |= ok & (np.bincount(who, minlength=len(sizes)) <= differ)
    single = short[d]
    who, one, rare = d[single], C.mix(s[single] + np.uint64(1)), level[single]
    at = firsts(who, one, rare, sizes - (-(-up * sizes // low)) + 1)
    out.append((who[at], one[at], rare[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def prefixes(sketch, n: int, up: int, low: int):
    """The first parts of every set, rare ones first; of copies in one task, one set's.

    With a column ``root``, shingles meet in their own class only.
    """
    def run(batches):
        levels = np.frombuffer(sketch.value, np.uint8)
        usual = np.median(levels[levels > 0]) if levels.any() else 0
        seen: set[int] = set()
        hot = max(np.log2(HOT) * 8, usual + 24)              # 24 levels: eight times the usual count
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                d, s, sizes, _ = shingle_sets(C.Words(offsets, data, lower=True), n)
                node = node_ids(d, s, sizes)
                if "root" in sub.schema.names:
                    d, s = within(d, s, _numbers(sub, "root"))
                if len(seen) > SEEN:
                    seen.clear()
                new = np.ones(len(sizes), bool)
                for k, x in enumerate(node.tolist()):            # copies: once per task
                    new[k] = x not in seen
                    seen.add(x)
                own = new[d]
                d, s = d[own], s[own]
                who, s, level = signatures(d, s, levels[s >> np.uint64(64 - WIDTH)], np.where(new, sizes, 0), up, low)
                salts = np.left_shift(np.uint64(1), np.clip(level // 8 + 1 - np.log2(HOT), 1, 30).astype(np.uint64))
                salt = np.where(level >= hot, (node[who] % salts).astype(np.int32), -1)
                yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(node[who].view(np.int64)),
                                       pa.array(sizes[who], pa.int64()), pa.array(salt, pa.int32())],
                                      names=[x.split()[0] for x in POSTINGS.split(", ")])
    return run


def stars(up: int, low: int):
    """Stars of the nodes of one part ("shingle"), over rows sorted by (shingle, salt, n, node).

    A gap in size that no link can cross ends a star. Salted shingles also hand on their hubs
    with the sizes they cover.
    """
    def run(batches):
        last = None                                   # shingle, salt, hub, first size, last size
        for batch in batches:
            if not batch.num_rows:
                continue
            s, node, n, salt = (_numbers(batch, c) for c in ("shingle", "node", "n", "salt"))
            ahead = (s[0], salt[0], n[0]) if last is None else (last[0], last[1], last[4])
            before_s, before_t, before_n = (np.concatenate([[x], y[:-1]]) for x, y in zip(ahead, (s, salt, n)))
            new = (s != before_s) | (salt != before_t) | (n * up > before_n * low)
            if last is None:
                new[0] = True
            first = np.flatnonzero(new)
            star = np.cumsum(new) - 1                 # -1: goes on with the last batch's star
            hubs = node[first]
            lead = last[2] if last is not None else 0
            hub = np.where(star >= 0, hubs[np.maximum(star, 0)] if len(hubs) else lead, lead)
            edge = np.flatnonzero(hub != node)
            ends = []
            if last is not None and new[0] and last[1] >= 0:
                ends.append((last[0], last[2], last[3], last[4]))
            if len(first):
                if last is not None and not new[0] and last[1] >= 0:
                    ends.append((last[0], last[2], last[3], n[first[0] - 1]))
                closed = first[:-1]
                stop = first[1:] - 1
                pick = np.flatnonzero(salt[closed] >= 0)
                ends += list(zip(s[closed[pick]], node[closed[pick]], n[closed[pick]], n[stop[pick]]))
                f = first[-1]
                last = (s[f], salt[f], node[f], n[f], n[-1])
            else:
                last = (*last[:4], n[-1])
            yield _edges(node[edge], hub[edge], ends)
        if last is not None and last[1] >= 0:
            yield _edges(np.zeros(0, np.int64), np.zeros(0, np.int64), [(last[0], last[2], last[3], last[4])])
    return run


def _edges(a, b, ends):
    k, m = len(a), len(ends)
    col = [pa.array([int(e[i]) for e in ends], pa.int64()) for i in range(4)]
    none, rest = pa.nulls(m, pa.int64()), pa.nulls(k, pa.int64())
    return pa.record_batch([pa.concat_arrays([pa.array(a, pa.int64()), none]), pa.concat_arrays([pa.array(b, pa.int64()), none]),
                            *(pa.concat_arrays([rest, c]) for c in col)], names=[x.split()[0] for x in EDGES.split(", ")])


def join_hubs(up: int, low: int):
    """Edges between the hubs of one salted shingle whose sizes come close enough."""
    def run(key, table):
        t = table.sort_by([("lo", "ascending"), ("node", "ascending")]).to_pydict()
        a, b, hub, reach = [], [], None, 0
        for node, lo, hi in zip(t["node"], t["lo"], t["hi"]):
            if hub is None or lo * up > reach * low:
                hub, reach = node, hi
            elif node != hub:
                a.append(node)
                b.append(hub)
            reach = max(reach, hi)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def whole_sets(n: int):
    def run(batches):
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                d, s, sizes, _ = shingle_sets(C.Words(offsets, data, lower=True), n)
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.record_batch([sub.column("node"), sub.column("root"), sub.column("tiles"),
                                       pa.array([s[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                                      names=[x.split()[0] for x in SETS.split(", ")])
    return run


def light_overlap(row, col, lo: int, hi: int, stop: int) -> np.ndarray:
    """Overlap counts of rows lo:hi with rows lo:stop, over columns sorted by (column, row): one for each pair of a column."""
    ok = (row >= lo) & (row < stop)
    row, col = row[ok], col[ok]
    total = np.zeros((hi - lo) * (stop - lo), np.float32)
    first = np.flatnonzero(row < hi)
    many = np.searchsorted(col, col[first], "right") - first - 1          # the later rows of the column
    upto = np.cumsum(many)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        x = np.repeat(row[first[at:end]], many[at:end])
        y = row[C.ranges(first[at:end] + 1, many[at:end])]
        total += np.bincount((x - lo) * (stop - lo) + (y - lo), minlength=len(total))
        at = end
    return total.reshape(hi - lo, stop - lo)


def block_links(sets: list[np.ndarray], side: np.ndarray, up: int, low: int):
    """Linked pairs (row, row) of one block; ``side`` 0/1: only pairs across, if both occur.

    Rows are sorted by size and only rows whose sizes allow a link are multiplied. The product is
    sparse: columns of at most ``LIGHT`` rows are multiplied pair by pair, the others by column blocks.
    """
    n = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n = n[order]
    row = np.repeat(np.arange(len(order)), n)
    _, col, many = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)

    def columns_where(keep):
        number = np.cumsum(keep) - 1
        own = keep[col]
        r, c = row[own], number[col[own]]
        by = np.argsort(c, kind="stable")
        return r[by], c[by], int(keep.sum())
    light_row, light_col, light = columns_where((many > 1) & (many <= LIGHT))   # a column of one row adds to no pair
    row, col, columns = columns_where(many > max(1, LIGHT))
    across = side.any() and not side.all()
    side = side[order]
    out = []
    step = 512
    # the last row whose size is at most n * low / up
    end = np.searchsorted(n * up, n * low, "right")
    for i in range(0, len(n), step):
        j = min(len(n), i + step)
        stop = int(end[j - 1])
        if not columns + light or stop <= i + 1:
            continue
        overlap = light_overlap(light_row, light_col, i, j, stop)
        for c in range(0, columns, COLUMNS):
            lo, hi = np.searchsorted(col, [c, c + COLUMNS])
            r, k = row[lo:hi], col[lo:hi] - c
            ok = (r >= i) & (r < stop)
            dense = np.zeros((stop - i, COLUMNS), np.float32)
            dense[r[ok] - i, k[ok]] = 1
            overlap += dense[:j - i] @ dense.T
        both = n[i:j, None] + n[None, i:stop]
        link = np.rint(overlap).astype(np.int64) * (low + up) >= both * up
        link &= np.arange(i, stop)[None, :] > np.arange(i, j)[:, None]
        if across:
            link &= side[i:j, None] != side[None, i:stop]
        x, y = np.nonzero(link)
        out.append((order[x + i], order[y + i]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def roots(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, by repeated minimum and pointer jumping."""
    label = np.arange(count)
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            return label


def block_stars(up: int, low: int):
    def run(key, table):
        node = table.column("node").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        side = (table.column("tile").to_numpy() == j) if i != j else np.zeros(len(node), bool)
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")]
        x, y = block_links(sets, side, up, low)
        label = roots(len(node), x, y)
        pick = np.flatnonzero(label != np.arange(len(node)))
        return pa.table([pa.array(node[pick]), pa.array(node[label[pick]])], names=["a", "b"])
    return run


def shared_sketch(parts: DataFrame):
    """The broadcast levels of all counters, from the tasks' slices."""
    found = parts.groupBy("slice").applyInArrow(add_slices, "slice int, level binary").collect()
    sketch = np.zeros(1 << WIDTH, np.uint8)
    for r in found:
        sketch[r["slice"] << SLICE:(r["slice"] + 1) << SLICE] = np.frombuffer(r["level"], np.uint8)
    return parts.sparkSession.sparkContext.broadcast(sketch.tobytes())


def candidate_classes(docs: DataFrame, sketch, n: int, up: int, low: int) -> DataFrame:
    """(node, root) of the nodes that share one of their first parts with another."""
    posted = docs.mapInArrow(prefixes(sketch, n, up, low), POSTINGS)
    sorted_ = posted.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "node")
    found = cut_lineage(sorted_.mapInArrow(stars(up, low), EDGES).distinct())
    hubs = (found.where("shingle is not null").select("shingle", "node", "lo", "hi")
            .groupBy("shingle").applyInArrow(join_hubs(up, low), "a long, b long"))
    return cut_lineage(components(found.where("a is not null").select("a", "b").unionByName(hubs)))


def class_tiles(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, rows, tiles) of every class."""
    return (classes.join(nodes, "node").groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
            .select("root", "rows", F.greatest(F.ceil(F.col("rows") / TILE_NODES), F.ceil(F.col("shingles") / TILE_SHINGLES))
                    .cast("int").alias("tiles")))


def split_classes(texts: DataFrame, classes: DataFrame, nodes: DataFrame, n: int, up: int, low: int) -> tuple[DataFrame, DataFrame]:
    """``classes`` with those of more than one tile taken apart by their own shingles, and their tiles.

    A set is sent once for every tile of its class, so these copies are what a round has to save;
    none is made while they are fewer than all sets of ``classes``.
    """
    before = None
    while True:
        tiles = cut_lineage(class_tiles(classes, nodes))
        rows, copies = tiles.agg(F.sum("rows"), F.sum(F.expr("if(tiles > 1, rows * tiles, 0)"))).first()
        if not copies or copies <= rows or (before is not None and copies > SAVED * before):
            return classes, tiles
        before = copies
        large = classes.join(tiles.where("tiles > 1").select("root"), "root", "left_semi")
        own = cut_lineage(texts.join(large, "node").select("node", "root", "text"))
        sketch = shared_sketch(own.mapInArrow(count_classes(n), SLICES))
        small = classes.join(tiles.where("tiles = 1").select("root"), "root", "left_semi")
        classes = cut_lineage(small.select("node", "root").unionByName(candidate_classes(own, sketch, n, up, low)))
        sketch.unpersist()


def node_links(docs: DataFrame, nodes: DataFrame, sketch, n: int, up: int, low: int) -> DataFrame:
    """Star links (a, b) between nodes; ``nodes``: (node, n, doc_id, text_key), one document each."""
    classes = candidate_classes(docs, sketch, n, up, low)
    rows = classes.join(nodes, "node")
    key = [docs["text_key"] == rows["text_key"], docs["doc_id"].eqNullSafe(rows["doc_id"])]
    texts = cut_lineage(docs.join(rows, key).select("node", "text"))
    classes, tiles = split_classes(texts, classes, nodes, n, up, low)
    rows = classes.join(tiles.select("root", "tiles"), "root")
    sets = texts.join(rows, "node").select("node", "root", "tiles", "text").mapInArrow(whole_sets(n), SETS)
    sets = sets.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = (sets.withColumn("other", other)
             .select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "shingles"))
    return pairs.groupBy("root", "i", "j").applyInArrow(block_stars(up, low), "a long, b long")


def join_classes(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key (hash of the text), n_shingles, component_id (smallest linked doc_id).

    ``threshold``: the Jaccard bound as a fraction (numerator, denominator).
    """
    up, low = threshold
    docs = keyed(docs, id_col, text_col)
    first = cut_lineage(docs.mapInArrow(describe(n), FIRST))
    members = first.where("slice is null").select("doc_id", "text_key", "n", "node")
    sketch = shared_sketch(first.where("slice is not null").select("slice", "counts"))
    nodes = cut_lineage(members.where("n > 0").groupBy("node", "n").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("one"))
        .select("node", "n", "first_id", "one.doc_id", "one.text_key"))
    links = node_links(docs, nodes.drop("first_id"), sketch, n, up, low)
    classes = components(links)
    # every node with its class's smallest document
    named = nodes.join(classes, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root").select("node", "n", "least_id")
    return members.join(named, ["node", "n"], "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
