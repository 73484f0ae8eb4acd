"""Conversation prefix trie with subtree totals by parallel tree contraction.

Conversations are rebuilt first: c takes the first h turns of the leader c - c % 5 (h from a checksum
of c), then its own turns after its first h. Every distinct sequence of first turns is a node of
the trie. A node is known by two 64-bit sums (exclusive or) of hashes of (place, role, text), so a
prefix is a running sum and a parent is a node's sum without its last turn.

Subtree totals (leaves, saved tokens) come from tree contraction. Every round rakes all leaves (their
totals go to their parents) and compresses unary chains (a node with a single child is taken out, its
sums wait on the child's edge). Each half is one grouped shuffle: nodes keep or send what
concerns them to the parent's or child's key, and sums of messages are formed before the shuffle, so
a parent of a third of all nodes gets a few rows. A node keeps the exclusive or of its children's keys;
with a single child left this is the child's key, so no join is needed to find it. No two neighbours
are taken out at once: a node goes if its coin is one and its parent's is zero. The coins of round k
are bit k of the depth, which halves a whole chain each round, then bits of a hash, which keep the
number of rounds logarithmic whatever becomes a chain later. Afterwards the rounds are undone from
the last to the first: a join gives each taken-out node the total of its child.

Hot groups: a conversation of any length is numbered by a global range sort, and its running sums
are made in chunks of ``CHUNK`` turns; nodes are partial aggregates. The ids that end at a node are
sorted by range over all tasks and joined to texts there; only these texts meet in one task, which
hashes them as a stream (a digest cannot be made in parts).

Defined results: rows without conv_id belong to no conversation; a null turn comes first; null
role and text are empty; turns that tie are ordered by hashes of role and text, so the input's order
plays no part, and repeated rows are turns of their own; an empty table has no node; a rebuilt
conversation without turns is a member of the root alone; other columns are ignored, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comboscore.operators.ordinal import with_ordinal
from comboscore.session import cut_lineage

CHUNK = 1024
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv, place in the whole table (g), two hashes and the text's bytes, for every turn; stored."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(7), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
        # tells repeated rows apart, so that any number of them can be dealt over partitions
        F.monotonically_increasing_id().alias("copy"))
    return with_ordinal(turns, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("copy")], "g").drop("turn", "copy")


def _families(turns: DataFrame, every: int, heads: int) -> DataFrame:
    """leader, members (conv, first, n, h, taken, total): at most 2 * ``every`` - 1 members, as ids differ."""
    convs = turns.groupBy("conv").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    convs = convs.select((F.col("conv") - F.col("conv") % every).alias("leader"), "conv", "first", "n",
                         (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    families = convs.groupBy("leader").agg(F.collect_list(F.struct("conv", "first", "n", "h")).alias("members"))
    of_leader = F.coalesce(F.try_element_at(F.filter("members", lambda x: x["conv"] == F.col("leader")), F.lit(1))["n"], F.lit(0))

    def sized(x):
        taken = F.least(x["h"], of_leader)
        return F.struct(x["conv"].alias("conv"), x["first"].alias("first"), x["h"].alias("h"), taken.alias("taken"),
                        (taken + F.greatest(x["n"] - x["h"], F.lit(0))).alias("total"))
    return families.select("leader", F.transform("members", sized).alias("members"))


def rebuilt_turns(turns: DataFrame, families: DataFrame, every: int) -> DataFrame:
    """conv, depth (from 1), last, h1, h2, bytes: the turns of the rebuilt conversations."""
    rows = turns.withColumn("leader", F.col("conv") - F.col("conv") % every).join(families, "leader")
    rows = rows.withColumn("me", F.element_at(F.filter("members", lambda x: x["conv"] == F.col("conv")), 1))
    rows = rows.withColumn("place", F.col("g") - F.col("me.first"))
    me, place = F.col("me"), F.col("place")

    def turn(x, depth):
        return F.struct(x["conv"].alias("conv"), depth.alias("depth"), (depth == x["total"]).alias("last"))
    own = F.when(place >= me["h"], F.array(turn(me, me["taken"] + place - me["h"] + 1)))
    given = F.when(F.col("conv") == F.col("leader"), F.transform(F.filter("members", lambda x: place < x["taken"]), lambda x: turn(x, place + 1)))
    none = F.array().cast("array<struct<conv:long,depth:long,last:boolean>>")
    rows = rows.select(F.explode(F.concat(F.coalesce(own, none), F.coalesce(given, none))).alias("x"), "h1", "h2", "bytes")
    return rows.select("x.*", "h1", "h2", "bytes")


def with_prefix(rows: DataFrame) -> DataFrame:
    """Adds the node's key a, b and its parent's pa, pb. Running sums are made chunk by chunk."""
    rows = rows.select("conv", "depth", "last", "bytes", F.xxhash64("depth", "h1", "h2").alias("e1"),
                       F.xxhash64(F.lit(1), "h2", "depth", "h1").alias("e2"), F.expr(f"(depth - 1) div {CHUNK}").alias("chunk"))
    upto = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut_lineage(rows.select("*", F.bit_xor("e1").over(upto).alias("a"), F.bit_xor("e2").over(upto).alias("b")))
    # a full chunk's last running sum is the chunk's; chunks before the own one are added
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    full = rows.where(F.col("depth") % CHUNK == 0)
    ahead = full.select("conv", (F.col("chunk") + 1).alias("chunk"), F.bit_xor("a").over(before).alias("a0"), F.bit_xor("b").over(before).alias("b0"))
    later = rows.where("chunk > 0").join(ahead, ["conv", "chunk"])
    later = later.withColumns({"a": F.col("a").bitwiseXOR(F.col("a0")), "b": F.col("b").bitwiseXOR(F.col("b0"))}).select(rows.columns)
    whole = rows.where("chunk = 0").unionByName(later)
    return whole.select("conv", "depth", "last", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("e1")).alias("pa"), F.col("b").bitwiseXOR(F.col("e2")).alias("pb"))


def _null(kind: str = "long") -> Column:
    return F.lit(None).cast(kind)


def _inline(df: DataFrame, *structs: Column) -> DataFrame:
    """One row per struct that is not null."""
    return df.select(F.explode(F.array_compact(F.array(*structs))).alias("x")).select("x.*")


def _nodes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Every node with its members, its children's number and the exclusive or of their keys; stored."""
    inner = rows.groupBy("a", "b").agg(F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("bytes").alias("bytes"),
                                       F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    zero = F.lit(0).cast("long")
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), _null().alias("pa"), _null().alias("pb"), zero.alias("bytes"), "n_convs", "conv_id")
    every = inner.unionByName(root)
    carried = ["depth", "pa", "pb", "bytes", "n_convs", "conv_id"]
    own = F.struct("a", "b", *carried, zero.alias("kids"), zero.alias("xa"), zero.alias("xb"))
    sent = F.when(F.col("depth") > 0, F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"), *(_null().alias(c) for c in carried),
                                               F.lit(1).cast("long").alias("kids"), F.col("a").alias("xa"), F.col("b").alias("xb")))
    return cut_lineage(_inline(every, own, sent).groupBy("a", "b").agg(
        *(F.max(c).alias(c) for c in carried), F.sum("kids").alias("kids"), F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb")))


def _rake(tree: DataFrame, sums: list[str]) -> DataFrame:
    """Leaves go; their sums and those waiting on their edges are added to their parents."""
    leaf = (F.col("kids") == 0) & (F.col("depth") > 0)

    def pick(sent, own):
        return F.when(leaf, sent).otherwise(own)
    kept = ["depth", "pa", "pb", "pdepth", *(f"w_{s}" for s in sums)]
    rows = tree.select(pick(F.col("pa"), F.col("a")).alias("a"), pick(F.col("pb"), F.col("b")).alias("b"),
                       *(F.when(~leaf, F.col(c)).alias(c) for c in kept), pick(F.lit(-1), F.col("kids")).alias("kids"),
                       pick(F.col("a"), F.col("xa")).alias("xa"), pick(F.col("b"), F.col("xb")).alias("xb"),
                       *(pick(F.col(s) + F.col(f"w_{s}"), F.col(s)).alias(s) for s in sums))
    return rows.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in kept), F.sum("kids").alias("kids"), F.bit_xor("xa").alias("xa"),
                                      F.bit_xor("xb").alias("xb"), *(F.sum(s).alias(s) for s in sums))


def _compress(tree: DataFrame, sums: list[str], turn: int, bits: int) -> DataFrame:
    """Chosen nodes with a single child go; the child keeps the record of it (va, vb, v_ sums)."""
    def coin(depth, a, b):
        if turn < bits:
            return F.shiftright(depth, turn).bitwiseAND(1) == 1
        return (depth > 0) & (F.pmod(F.xxhash64(F.lit(turn), a, b), F.lit(2)) == 1)
    c = F.col
    goes = (c("kids") == 1) & (c("depth") > 0) & coin(c("depth"), c("a"), c("b")) & ~coin(c("pdepth"), c("pa"), c("pb"))
    state = ["depth", "pa", "pb", "pdepth", *(f"w_{s}" for s in sums)]
    news = ["npa", "npb", "npdepth", "va", "vb", *(f"add_{s}" for s in sums), *(f"v_{s}" for s in sums)]
    zero = F.lit(0).cast("long")

    def message(**values):
        columns = ["a", "b", *state, *news]
        return F.struct(*(values.get(x, _null()).alias(x) for x in columns), *(values.get(x, zero).alias(x) for x in ["kids", "xa", "xb", *sums]))
    stay = F.when(~goes, message(**{x: c(x) for x in ["a", "b", *state, "kids", "xa", "xb", *sums]}))
    to_child = F.when(goes, message(a=c("xa"), b=c("xb"), npa=c("pa"), npb=c("pb"), npdepth=c("pdepth"), va=c("a"), vb=c("b"),
                                    **{f"add_{s}": c(s) + c(f"w_{s}") for s in sums}, **{f"v_{s}": c(s) for s in sums}))
    to_parent = F.when(goes, message(a=c("pa"), b=c("pb"), xa=c("a").bitwiseXOR(c("xa")), xb=c("b").bitwiseXOR(c("xb"))))
    merged = _inline(tree, stay, to_child, to_parent).groupBy("a", "b").agg(
        *(F.max(x).alias(x) for x in [*state, *news]), F.sum("kids").alias("kids"), F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"),
        *(F.sum(s).alias(s) for s in sums))
    return merged.select("a", "b", "depth", *(F.coalesce(f"n{x}", x).alias(x) for x in ("pa", "pb", "pdepth")), "kids", "xa", "xb", *sums,
                         *(F.coalesce(c(f"w_{s}") + c(f"add_{s}"), c(f"w_{s}")).alias(f"w_{s}") for s in sums), "va", "vb",
                         *((c(f"v_{s}") + c(f"w_{s}")).alias(f"v_{s}") for s in sums))


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """Totals of the long columns ``sums`` over every node's subtree: a, b and the sums.

    ``nodes`` is a stored tree: a, b, depth (root: 0), pa, pb, kids, xa, xb (exclusive or of the
    children's keys), and the sums.
    """
    zero = F.lit(0).cast("long")
    tree = nodes.select("a", "b", "depth", "pa", "pb", (F.col("depth") - 1).alias("pdepth"), "kids", "xa", "xb", *sums, *(zero.alias(f"w_{s}") for s in sums))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("a", "b", *sums)
    rounds = [tree]
    while rounds[-1].count() > 1:
        turn = len(rounds) - 1
        rounds.append(cut_lineage(_compress(_rake(rounds[-1], sums), sums, turn, int(deepest).bit_length())))
    known = rounds[-1].select("a", "b", *sums)
    for before, after in zip(rounds[-2::-1], rounds[:0:-1]):
        # nodes taken out in this round hang on nodes whose totals are known by now
        out = after.where(F.col("va").isNotNull()).select("a", "b", "va", "vb", *(F.col(f"v_{s}") for s in sums)).join(known, ["a", "b"])
        out = cut_lineage(out.select(F.col("va").alias("a"), F.col("vb").alias("b"), *((F.col(s) + F.col(f"v_{s}")).alias(s) for s in sums)))
        raked = before.where("kids = 0 and depth > 0").select("a", "b", *sums)
        known = known.unionByName(out).unionByName(raked)
    return known


def _runs(batch: pa.RecordBatch):
    """First and last row + 1 of each run of equal (a, b)."""
    a, b = (batch.column(x).to_numpy(zero_copy_only=False) for x in "ab")
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    return a[begin], b[begin], begin.tolist(), [*begin[1:].tolist(), len(a)]


def _listed(batches):
    """Sorted a, b, conv -> a, b, first id, the ids of a run as text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, begin, end = _runs(batch)
        ids = batch.column("conv").to_pylist()
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array([ids[i] for i in begin], pa.int64()),
                               pa.array([",".join(map(str, ids[i:j])) for i, j in zip(begin, end)])], names=["a", "b", "first", "ids"])


def _digests(batches):
    """Texts sorted by node and first id -> a, b, digest of the joined texts."""
    key, digest = None, None

    def done(keys, digests):
        return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(digests, pa.string())],
                               names=["a", "b", "ends_sha256"])
    for batch in batches:
        keys, digests = [], []
        for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ids"))):
            if key == (a, b):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                digests.append(digest.hexdigest())
            key, digest = (a, b), hashlib.sha256(ids.encode())
        yield done(keys, digests)
    if key is not None:
        yield done([key], [digest.hexdigest()])


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, SHA-256 of the ids (ascending, comma-joined) of ``ends`` (a, b, conv)."""
    texts = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(_listed, "a long, b long, first long, ids string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """One row per node: a, b (its key), pa, pb (its parent's), and the columns of ``NODES``."""
    turns = _numbered(conversations)
    families = cut_lineage(_families(turns, every, heads))
    members = families.select(F.explode("members").alias("x")).select("x.conv", "x.total")
    rows = with_prefix(rebuilt_turns(turns, families, every))
    nodes = _nodes(rows, members)
    tree = nodes.select("a", "b", "depth", "pa", "pb", "kids", "xa", "xb", (F.col("kids") == 0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    zero = F.lit(0).cast("long")
    ends = rows.where("last").select("a", "b", "conv").unionByName(members.where("total = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = (nodes.join(totals, ["a", "b"]).join(end_digests(ends), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
           .withColumnRenamed("kids", "n_children").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))))
    return out.select("a", "b", "pa", "pb", *(F.col(x.split()[0]).cast(x.split()[1]) for x in NODES.split(", ")))
