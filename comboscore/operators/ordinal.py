"""Row positions, head/tail/slice, splits, batches and positional alignment.

Spark has no row index, so position is defined by an explicit order. ``with_ordinal``
numbers rows 0..N-1 without funnelling them through one task:

1. ``repartitionByRange`` on the order (sampled boundaries, balanced partitions) and sort
   inside each partition; every row carries its partition number and its place there;
2. the ranged table is written once to the shared checkpoint folder, so partition and
   place are values of the stored row from then on;
3. rows per partition are counted on the stored table (one row per partition, so its size
   is bounded by the partition count), turned into start offsets and joined back.

Counting and numbering read the same stored values. Two evaluations of a range shuffle
would not do: each samples its own boundaries and may be coalesced differently. A global
``row_number()`` would move every row into a single partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comboscore.session import cut_lineage

_LOCAL_BITS = 33
TOP = 100_000       # rows that one task may hold as the first of an order


def _cols(order) -> list[Column]:
    if isinstance(order, (str, Column)):
        order = [order]
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_ordinal(df: DataFrame, order, name: str = "ordinal", total: str | None = None) -> DataFrame:
    """Add a dense 0-based position by ``order`` (plus the row count as ``total``, if named).

    Rows that tie on ``order`` get distinct but arbitrary positions; give a unique order for
    reproducible numbering. The rows are stored once in the shared checkpoint folder.
    """
    cols = _cols(order)
    place = F.col("_mid") - F.shiftleft(F.shiftright("_mid", _LOCAL_BITS), _LOCAL_BITS)
    stored = cut_lineage(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                         .withColumn("_mid", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
                         .withColumn("_place", place).drop("_mid"))
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_total"))
    out = stored.join(F.broadcast(offsets), "_part")
    out = out.withColumn(name, (F.col("_off") + F.col("_place")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.drop("_part", "_place", "_off", "_total")


def head(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows by ``order``, sorted (Spark plans a top-k per partition and one merge)."""
    return df.orderBy(*_cols(order)).limit(n)


def tail(df: DataFrame, n: int, order) -> DataFrame:
    """Last ``n`` rows by ``order``, last first."""
    return df.orderBy(*(c.desc() for c in _cols(order))).limit(n)


def slice_rows(df: DataFrame, start: int, n: int, order, name: str = "ordinal") -> DataFrame:
    """Rows at positions [start, start + n); ``n`` is clamped to the end of the table."""
    o = with_ordinal(df, order, name)
    return o.where((F.col(name) >= start) & (F.col(name) < start + n))


def contiguous_split(df: DataFrame, order, test: int = 1000, train_frac: float = 0.9,
                     name: str = "split") -> DataFrame:
    """test = first ``test`` rows; of the rest, train = int(train_frac * rest), eval = remainder."""
    o = with_ordinal(df, order, "_pos", total="_n")
    rest = F.greatest(F.col("_n") - test, F.lit(0))
    n_train = F.floor(rest * F.lit(float(train_frac))).cast("long")
    split = (F.when(F.col("_pos") < test, "test")
             .when(F.col("_pos") < F.lit(test) + n_train, "train")
             .otherwise("eval"))
    return o.withColumn(name, split).drop("_pos", "_n")


def hash_order(key, seed: int) -> Column:
    """Reproducible shuffle order: md5 of ``seed:key`` (same digits in every engine)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def random_split(df: DataFrame, key: str, seed: int, test_size: float = 0.2,
                 name: str = "split") -> DataFrame:
    """Seeded 80/10/10 split with exact sizes.

    n_test = ceil(test_size * N), train = the other rows; the held-out part is halved again
    with n_test2 = ceil(n_test / 2) -> "test" and the rest -> "valid".
    """
    o = with_ordinal(df, [hash_order(key, seed), F.col(key)], "_pos", total="_n")
    n_test = F.ceil(F.col("_n") * F.lit(float(test_size))).cast("long")
    n_train = F.col("_n") - n_test
    n_valid = n_test - F.ceil(n_test / F.lit(2.0)).cast("long")
    split = (F.when(F.col("_pos") < n_train, "train")
             .when(F.col("_pos") < n_train + n_valid, "valid")
             .otherwise("test"))
    return o.withColumn(name, split).drop("_pos", "_n")


def batches(df: DataFrame, key: str, size: int, seed: int | None = None,
            name: str = "batch_id") -> DataFrame:
    """Fixed-size batches: in key order, or in a seeded shuffled order when ``seed`` is set."""
    order = [F.col(key)] if seed is None else [hash_order(key, seed), F.col(key)]
    o = with_ordinal(df, order, "_pos")
    return o.withColumn(name, F.floor(F.col("_pos") / size).cast("long")).drop("_pos")


def align(left: DataFrame, right: DataFrame, left_order, right_order, n: int | None = None,
          how: str = "inner", name: str = "ordinal") -> DataFrame:
    """Pair rows by position. ``inner`` truncates to the shorter side; ``left`` keeps the
    left length (short right side -> NULL, extra right rows dropped). ``n`` keeps only the
    first n positions of both sides."""
    if n is not None and n <= TOP:
        # the first rows of each side only: nothing else is numbered or stored
        left, right = head(left, n, left_order), head(right, n, right_order)
    lo = with_ordinal(left, left_order, name)
    ro = with_ordinal(right, right_order, name)
    if n is not None:
        lo = lo.where(F.col(name) < n)
        ro = ro.where(F.col(name) < n)
    return lo.join(ro, on=name, how=how)


def pad_length(df: DataFrame, length_col, batch_col: str = "batch_id", name: str = "pad_len") -> DataFrame:
    """Longest sequence in each batch (dynamic padding length)."""
    c = F.col(length_col) if isinstance(length_col, str) else length_col
    return df.withColumn(name, F.max(c).over(Window.partitionBy(batch_col)))
