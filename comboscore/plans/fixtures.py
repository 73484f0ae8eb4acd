"""Reference-shaped tables derived from the driver's parquet tables.

The reference works on pair-score files, combination lists, prompt tables and model
responses. These functions derive the same shapes from ``lineitem``, ``conversations``,
``documents`` and ``embeddings`` so that every operator runs on data whose size grows with
the scale factor. Each derivation has a twin in ``plans/oracle.py`` written in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from comboscore.functions.text import decimal_text
from comboscore.session import deal

# Fixed parameters of the derived views (ids wrap at MODULUS; names are "Drug-<id>").
MODULUS = 60
MISSING_MODULUS = 200
GRAPH_MODULUS = 1000
COMBO_MAX = 5          # items of one combination
GROUPS = 1000          # combination numbers of one order
NAME_PREFIX = "Drug-"
ORDER_COLS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``lineitem``, from the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def drug_name(c) -> F.Column:
    return F.concat(F.lit(NAME_PREFIX), c.cast("string"))


def pair_scores(spark: SparkSession, sf_dir: str, sparse: bool = False, graph: bool = False) -> DataFrame:
    """Pair-score rows; file order = ``ORDER_COLS``.

    Default: ids 0-59, every pair present. ``sparse``: ids 0-199, part of the pairs
    missing. ``graph``: ids 0-999, a sparse compatibility graph (random cliques hit dead
    ends). Columns: the five order columns, id_a, id_b, name_a, name_b, bliss, loewe, hsa,
    zip, loewe_text.
    """
    li = table(spark, sf_dir, "lineitem")
    id_a = (F.col("l_partkey") % MODULUS).cast("int")
    if sparse:
        id_a = (F.col("l_partkey") % MISSING_MODULUS).cast("int")
        id_b = (F.col("l_suppkey") % MISSING_MODULUS).cast("int")
    elif graph:
        id_a = (F.col("l_partkey") % GRAPH_MODULUS).cast("int")
        id_b = ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % GRAPH_MODULUS).cast("int")
    else:
        id_b = ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % MODULUS).cast("int")
    zip_ = (F.when(F.col("l_returnflag") == "R", F.round((F.col("l_quantity") - 25) * F.lit(0.8), 4))
            .otherwise(F.round((F.col("l_quantity") - 1) * F.lit(0.4), 4)))
    df = (li.select(*ORDER_COLS,
                    id_a.alias("id_a"), id_b.alias("id_b"),
                    F.round(F.col("l_discount") * 10 - 0.5, 4).alias("bliss"),
                    F.round(F.col("l_tax") * 10 - 0.4, 4).alias("loewe"),
                    F.round((F.col("l_linenumber") - 4) / F.lit(10.0), 4).alias("hsa"),
                    zip_.alias("zip"))
          .where(F.col("id_a") != F.col("id_b")))
    return (df.withColumn("name_a", drug_name(F.col("id_a")))
            .withColumn("name_b", drug_name(F.col("id_b")))
            .withColumn("loewe_text", decimal_text(F.col("loewe"))))


def growing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair-score rows whose ids grow with the data: every item (``l_partkey``) with the next line's
    item of its order; the columns of ``pair_scores``. There are nearly as many pairs as lines, so
    the lookup outgrows a broadcast as the tables grow."""
    li = deal(table(spark, sf_dir, "lineitem"), lines(spark, sf_dir), "l_orderkey")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*ORDER_COLS[1:]))
    zip_ = (F.when(F.col("l_returnflag") == "R", F.round((F.col("l_quantity") - 25) * F.lit(0.8), 4))
            .otherwise(F.round((F.col("l_quantity") - 1) * F.lit(0.4), 4)))
    df = li.select(*ORDER_COLS, F.col("l_partkey").cast("int").alias("id_a"), after.cast("int").alias("id_b"),
                   F.round(F.col("l_discount") * 10 - 0.5, 4).alias("bliss"),
                   F.round(F.col("l_tax") * 10 - 0.4, 4).alias("loewe"),
                   F.round((F.col("l_linenumber") - 4) / F.lit(10.0), 4).alias("hsa"),
                   zip_.alias("zip")).where(F.col("id_a") != F.col("id_b"))
    return (df.withColumn("name_a", drug_name(F.col("id_a"))).withColumn("name_b", drug_name(F.col("id_b")))
            .withColumn("loewe_text", decimal_text(F.col("loewe"))))


def combo_members(spark: SparkSession, sf_dir: str, modulus: int | None = MODULUS) -> DataFrame:
    """(combo_id, pos, id): per order the distinct ``l_partkey % modulus`` (the key itself without a
    modulus) in order of first appearance, cut into groups of ``COMBO_MAX`` at most; groups of at least two. Every item of
    an order stays; group g of order o is combination ``o * GROUPS + g``.

    Lines are dealt out by order once; the aggregate and both windows keep that partitioning.
    """
    li = deal(table(spark, sf_dir, "lineitem"), lines(spark, sf_dir), "l_orderkey")
    item = F.col("l_partkey") if modulus is None else F.col("l_partkey") % modulus
    first = (li.select(F.col("l_orderkey"), item.cast("int").alias("id"),
                       F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"))
             .groupBy("l_orderkey", "id").agg(F.min("k").alias("k")))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("k")) - 1
    group = F.floor(F.col("_place") / COMBO_MAX).cast("long")
    ranked = first.withColumn("_place", place).select(
        (F.col("l_orderkey") * GROUPS + group).alias("combo_id"),
        (F.col("_place") % COMBO_MAX + 1).cast("long").alias("pos"), "id", "l_orderkey", group.alias("_g"))
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "_g"))
    return ranked.withColumn("_n", n).where(F.col("_n") >= 2).select("combo_id", "pos", "id")


def combos(spark: SparkSession, sf_dir: str, modulus: int | None = MODULUS) -> DataFrame:
    """(combo_id, ids ARRAY<INT>) in member order — the parsed combination list."""
    m = deal(combo_members(spark, sf_dir, modulus), lines(spark, sf_dir), "combo_id")
    return (m.groupBy("combo_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_s"))
            .select("combo_id", F.transform("_s", lambda x: x["id"]).alias("ids")))
