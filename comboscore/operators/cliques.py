"""Compatibility graph and reproducible random cliques.

Randomness is a pure function of (seed, draw, step) via md5, so results do not depend on
partitioning or re-execution after a lost executor, and plain SQL can reproduce them.
Candidate arrays stay sorted (``array_intersect`` / ``array_except`` keep the order of
their first argument), so "the k-th candidate" is well defined and a pick costs one hash.

Neighbour lists are kept in blocks (``adjacency_blocks``): a row holds the neighbours of one
item whose ids fall into one range of ``BLOCK`` ids, so no row is as long as a hub's degree,
a hub's list is spread over as many rows as it has blocks, and two lists meet block by block.
``sample_cliques`` and ``common_neighbours`` have one plan for hubs and others.

``sample_cliques`` grows every draw in lock-step. A draw is one row per block of its remaining
candidates (the common neighbours of everything chosen so far), kept as bits (``bit_blocks``): one bit
per id in words of 64, so an intersection is an AND per word, a count is a count of bits, and a
row that the windows sort is ``BLOCK`` / 8 bytes long, however many candidates it holds. The k-th candidate lies in the
block whose running count reaches k, which a window over the draw's rows finds; an equi-join on
(item, block) intersects the candidates with the new item's neighbours. The first two items need
no candidates at all: they are looked up by position. The first pick is uniform over all items:
items get dense positions 0..n-1 (``with_ordinal``) and the draw joins on ``hash mod n``.

``common_neighbours`` begins with the member of the smallest degree, so a hub's list is read
only in the blocks where the other members leave candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from comboscore.operators.ordinal import with_ordinal
from comboscore.session import cut_lineage, deal

HEX8 = 8  # hex digits used for a uniform integer
BLOCK = 1024  # ids of one block, so neighbours of one row at most
WORD = 64  # ids of one word of bits


def edges(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Distinct directed edges (src, dst), both directions of every pair."""
    fwd = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    bwd = pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"))
    return fwd.unionByName(bwd).distinct()


def adjacency(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, neighbours ARRAY sorted): undirected neighbour sets."""
    fwd = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    bwd = pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"))
    # collect_set dedupes map-side, so this is a single shuffle on src
    return (fwd.unionByName(bwd).groupBy("src")
            .agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
            .withColumnRenamed("src", "id"))


def _block(c: str | Column, size: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(size)).cast("long")


def adjacency_blocks(pairs: DataFrame, a: str = "id_a", b: str = "id_b", size: int = BLOCK) -> DataFrame:
    """(id, block, neighbours ARRAY sorted): undirected neighbour sets in blocks of ``size`` ids.

    Duplicates go in a partial aggregate first; the lists are grouped by (id, block), so a hub's
    neighbours are dealt over tasks.
    """
    return _blocks_of(edges(pairs, a, b), size)


def _blocks_of(edge_table: DataFrame, size: int) -> DataFrame:
    return (edge_table.groupBy(F.col("src").alias("id"), _block("dst", size).alias("block"))
            .agg(F.array_sort(F.collect_set("dst")).alias("neighbours")))


def in_blocks(adj: DataFrame, size: int = BLOCK) -> DataFrame:
    """An adjacency in blocks; whole lists (id, neighbours) are split."""
    if "block" in adj.columns:
        return adj.select("id", "block", "neighbours")
    return _blocks_of(adj.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")), size)


def bit_blocks(adj: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, block, bits ARRAY<LONG>): undirected neighbour sets without the item itself, a bit per
    id of a block of ``size`` ids. ``adj``: whole lists, or blocks of any size."""
    e = adj.select("id", F.explode("neighbours").alias("_x")).where("_x is not null and not (_x <=> id)")
    place = F.col("_x").cast("long") - _block("_x", size) * size
    e = e.select("id", _block("_x", size).alias("block"), F.floor(place / WORD).cast("int").alias("_w"),
                 F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int")).alias("_bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_w") == w, F.col("_bit"))), F.lit(0).cast("long")) for w in range(-(-size // WORD))]
    return e.groupBy("id", "block").agg(F.array(*words).alias("bits"))


def _and(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _count(bits: str) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))


def _bits_of(word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(word, b) == 1)


def _kth(bits: str, k: Column, size: int, dtype) -> Column:
    """The id at place ``k`` (from 0) of a block's sorted ids."""
    none = F.lit(0).cast("long")
    start = F.struct(k.cast("long").alias("left"), F.lit(0).alias("at"), none.alias("word"), F.lit(False).alias("found"))

    def step(a, x):
        here = a["left"] < F.bit_count(x)
        return F.when(a["found"], a).when(here, F.struct(a["left"].alias("left"), a["at"].alias("at"), x.alias("word"), F.lit(True).alias("found"))) \
            .otherwise(F.struct((a["left"] - F.bit_count(x)).alias("left"), (a["at"] + 1).alias("at"), a["word"].alias("word"), F.lit(False).alias("found")))
    # the id is made inside the fold's last step, so that the fold is written once
    return F.aggregate(bits, start, step, lambda a: (F.col("block") * size + a["at"] * WORD
                                                     + F.get(_bits_of(a["word"]), a["left"].cast("int"))).cast(dtype))


def whole_lists(blocks: DataFrame) -> DataFrame:
    """(id, neighbours ARRAY sorted) from blocks, for consumers that need one row per item."""
    parts = blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "neighbours"))).alias("_p"))
    return parts.select("id", F.flatten(F.transform("_p", lambda x: x["neighbours"])).alias("neighbours"))


def symmetric(adj: DataFrame) -> DataFrame:
    """Keep only edges present in both directions (for hand-made adjacency input)."""
    e = adj.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))
    both = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return (both.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
            .withColumnRenamed("src", "id"))


def valid_extensions(groups: DataFrame, edge_table: DataFrame, key: str = "key",
                     members: str = "members", new: str = "new_id") -> DataFrame:
    """(key, valid): ``new`` is compatible when it neighbours every member in both
    directions; an empty group is always valid."""
    m = groups.select(key, new, F.explode_outer(members).alias("_m"))
    e = cut_lineage(edge_table.select("src", "dst"))
    fwd = e.select(F.col("src").alias("_m"), F.col("dst").alias(new), F.lit(True).alias("_f"))
    bwd = e.select(F.col("dst").alias("_m"), F.col("src").alias(new), F.lit(True).alias("_b"))
    j = m.join(fwd, ["_m", new], "left").join(bwd, ["_m", new], "left")
    ok = F.col("_m").isNull() | (F.coalesce(F.col("_f"), F.lit(False)) & F.coalesce(F.col("_b"), F.lit(False)))
    return j.groupBy(key).agg(F.bool_and(ok).alias("valid"))


def common_neighbour_blocks(groups: DataFrame, adj: DataFrame, key: str = "combo_id", members: str = "ids",
                            size: int = BLOCK) -> DataFrame:
    """(key, block, candidates ARRAY sorted): items adjacent to every member and not a member, in
    blocks; a group without candidates has no row.

    Lists are intersected block by block as bits (``bit_blocks``), in order of degree: the shortest
    list is the only one that is read whole.
    """
    # without the item itself: a member drops out in its own list
    item = adj.schema["neighbours"].dataType.elementType
    blocks = cut_lineage(bit_blocks(adj, size))
    degree = blocks.groupBy("id").agg(F.sum(_count("bits")).alias("_deg"))
    # a group's members stand in one row already, so they may meet in one row again; stored, as the
    # groups are read twice
    ranked = cut_lineage(
        groups.select(key, F.explode(F.array_distinct(members)).alias("id")).join(degree, "id", "left")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_deg", F.lit(0)).alias("d"), "id"))).alias("_s"))
        .select(key, F.transform("_s", lambda x: x["id"]).alias("_m")))
    longest, rows = ranked.agg(F.max(F.size("_m")), F.count(F.lit(1))).first()
    # narrow rows become lists: they are few bytes, which a few tasks would read
    ranked = deal(ranked, rows, key)
    state = (ranked.withColumn("id", F.get("_m", F.lit(0))).join(blocks, "id")
             .select(key, "_m", "block", F.col("bits").alias("cand")))
    other = blocks.select(F.col("id").alias("_jk"), "block", F.col("bits").alias("_nb"))
    for k in range(1, longest or 0):
        # a group of k members or fewer has a NULL key and keeps its candidates
        state = state.withColumn("_jk", F.get("_m", F.lit(k))).join(other, ["_jk", "block"], "left")
        done = F.col("_jk").isNull()
        # the lambda ends the generated method: all joins in one would outgrow the JIT's limit
        both = F.when(done, F.col("cand")).otherwise(_and("cand", "_nb"))
        state = state.select(key, "_m", "block", both.alias("cand")).where(F.exists("cand", lambda x: x != 0))
    return state.select(key, "block", _ids_of(size, item)("cand", "block").alias("candidates"))


def _ids_of(size: int, item):
    """(bits, block) -> the block's sorted ids, whole Arrow batches at a time."""
    words = -(-size // WORD)

    @F.arrow_udf(T.ArrayType(item))
    def ids(bits: pa.Array, block: pa.Array) -> pa.Array:
        flat = bits.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(bits), words)
        row, place = np.nonzero(np.unpackbits(flat.view(np.uint8), axis=1, bitorder="little"))
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(bits)))]).astype(np.int32)
        first = block.to_numpy(zero_copy_only=False) * size
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(first[row] + place).cast(to_arrow_type(item)))
    return ids


def common_neighbours(groups: DataFrame, adj: DataFrame, key: str = "combo_id",
                      members: str = "ids") -> DataFrame:
    """(key, candidates ARRAY sorted): items adjacent to every member and not a member; one row
    per group, so the result's lists are as long as the answer."""
    found = common_neighbour_blocks(groups, adj, key, members)
    agg = (found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "candidates"))).alias("_p"))
           .select(key, F.flatten(F.transform("_p", lambda x: x["candidates"])).alias("candidates")))
    return (groups.select(key).join(agg, key, "left")
            .select(key, F.coalesce("candidates", F.array().cast("array<int>")).alias("candidates")))


def _uniform(seed: int, draw: Column, tag: str) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(f":{tag}")))
    return F.conv(F.substring(h, 1, HEX8), 16, 10).cast("long")


def sample_cliques(adj: DataFrame, draws: DataFrame, seed: int, size_range=(2, 5),
                   draw: str = "draw", size: int = BLOCK) -> DataFrame:
    """(draw, target, combo ARRAY<INT>) for every draw that reached its target size.

    Per draw: target uniform in ``size_range`` (two items or more); first item uniform over all
    items; each next item uniform over the common neighbours of the chosen items; a draw whose
    candidates run out is dropped. Items and neighbours are integer ids; an item is never its own
    neighbour. ``adj``: whole lists or blocks.
    """
    lo, hi = size_range
    if lo < 2:
        raise ValueError("a draw has two items at least")
    # the blocks feed the item count, the item index and every step's join: store them once
    places = Window.partitionBy("id")
    ahead = F.sum("n").over(places.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = cut_lineage(in_blocks(adj, size).withColumn("neighbours", F.array_remove("neighbours", F.col("id")))
                         .withColumn("n", F.size("neighbours").cast("long"))
                         .withColumn("before", F.coalesce(ahead, F.lit(0).cast("long"))).withColumn("degree", F.sum("n").over(places)))
    items = blocks.select("id").distinct()
    n_items = items.count()
    if n_items == 0:
        return draws.select(F.col(draw), F.lit(0).alias("target"),
                            F.array().cast("array<int>").alias("combo")).where(F.lit(False))
    indexed = with_ordinal(items, "id", "_idx")
    d = F.col(draw)
    # draws are narrow rows that come from few files and cost much work each: deal them out by key,
    # once and always; the windows below keep this partitioning
    start = (deal(draws.select(draw), draws.count(), draw).select(d, (F.lit(lo) + _uniform(seed, d, "size") % (hi - lo + 1)).cast("int").alias("target"),
                          (_uniform(seed, d, "first") % n_items).alias("_idx")).join(indexed, "_idx"))
    k = _uniform(seed, d, "2") % F.nullif(F.col("degree"), F.lit(0))
    pairs = (start.join(blocks, "id").withColumn("_k", k).where("_k >= before and _k < before + n")
             .select(d, "target", F.array(F.col("id"), F.element_at("neighbours", (F.col("_k") - F.col("before") + 1).cast("int"))).alias("combo")))
    # a draw that is complete has one row without candidates; one that still grows a row per block
    bits = cut_lineage(bit_blocks(blocks, size))
    nb = bits.select(F.col("id").alias("_jk"), "block", F.col("bits").alias("_nb"))
    growing = F.size("combo") < F.col("target")
    first = bits.select(F.col("id").alias("_first"), "block", F.col("bits").alias("cand"))
    state = (pairs.withColumn("_first", F.when(growing, F.get("combo", F.lit(0)))).join(first, "_first", "left")
             .withColumn("_jk", F.when(growing, F.get("combo", F.lit(1)))).join(nb, ["_jk", "block"], "left"))
    of_draw = Window.partitionBy(draw)
    item = pairs.schema["combo"].dataType.elementType
    for step in range(3, hi + 1):
        state = (state.select(d, "target", "combo", "block", F.when(growing, _and("cand", "_nb")).alias("cand"))
                 .where(~growing | F.exists("cand", lambda x: x != 0)))
        n = F.when(growing, _count("cand")).otherwise(0)
        upto = F.sum("_n").over(of_draw.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
        state = (state.withColumn("_n", n).withColumn("_upto", upto).withColumn("_k", _uniform(seed, d, str(step)) % F.nullif(F.sum("_n").over(of_draw), F.lit(0))))
        place = F.col("_k") - F.col("_upto") + F.col("_n")
        state = state.withColumn("_here", F.when((place >= 0) & (place < F.col("_n")), _kth("cand", place, size, item)))
        state = state.withColumn("_pick", F.max("_here").over(of_draw))
        was_done = F.col("_pick").isNull()
        last = F.size("combo") + 1 == F.col("target")
        # of a draw that is now complete the row with the pick stays
        state = (state.where(was_done | ~last | F.col("_here").isNotNull())
                 .select(d, "target", F.when(was_done, F.col("combo")).otherwise(F.array_append("combo", F.col("_pick"))).alias("combo"),
                         F.when(~was_done & ~last, F.col("_pick")).alias("_jk"), F.when(~was_done & ~last, F.col("block")).alias("block"),
                         F.when(~was_done & ~last, F.col("cand")).alias("cand"))
                 .join(nb, ["_jk", "block"], "left"))
    return state.where(~growing).select(d, "target", "combo")
