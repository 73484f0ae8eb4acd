"""File sources and sinks: CSV shards, headerless / padded CSV, landed JSON pages,
adjacency as JSON.

Reads always take an explicit schema (no inference pass). File order, where it matters,
is one sortable column: (place of the path in the list, file name, start of the file block,
place in the block), taken from the ``_metadata`` column, so a read of many files stays
splittable and parallel. Rows of one block are read by one task from front to back, which
makes the task's row id rise with the place; how blocks are dealt to tasks does not matter.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comboscore.session import checkpoint_dir


def landing_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "landing", f"{name}-{uuid.uuid4().hex[:12]}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
               glob: str | None = "*.csv", multiline: bool = False, strip: bool = False,
               with_order: bool = False) -> DataFrame:
    """Headered (or headerless) CSV with a fixed schema.

    ``multiline`` keeps quoted newlines inside a field; ``strip`` drops blanks before a
    quoted cell (``a, "b, c"``). ``with_order`` adds the column ``_order``, which sorts rows
    into file order (see ``file_order``).
    """
    r = (spark.read.schema(schema).option("header", header).option("escape", '"')
         .option("multiLine", multiline).option("mode", "PERMISSIVE"))
    if glob:
        r = r.option("pathGlobFilter", glob)
    if strip:
        r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = r.csv(path)
    if with_order:
        df = df.select("*", file_order().alias(ORDER))
    return df


ORDER = "_order"


def file_order(shard: int = 0) -> Column:
    """Sort key of a row of a file scan: (shard, file, block, place). Apply it to the scan itself,
    before any filter or shuffle."""
    return F.struct(F.lit(shard).alias("shard"), F.col("_metadata.file_name").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("place"))


def read_shards(spark: SparkSession, paths: list[str], schemas: list[T.StructType | str],
                with_order: bool = False) -> DataFrame:
    """Union of CSV shard groups by column name; columns missing in a group are NULL.

    ``with_order`` adds ``_order``: rows of an earlier path come before those of a later one,
    inside a path files go by name and rows by their place. Number rows by it with
    ``with_ordinal``, or give it to ``dedup_pairs`` for the first or last row of a pair.
    """
    out = None
    for k, (p, s) in enumerate(zip(paths, schemas)):
        part = read_table(spark, p, s)
        if with_order:
            part = part.select("*", file_order(k).alias(ORDER))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_headerless(spark: SparkSession, path: str, names: list[str], glob: str | None = "*.csv") -> DataFrame:
    """CSV without a header row; columns named by position."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return read_table(spark, path, schema, header=False, glob=glob, multiline=True)


def write_table(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """Headered CSV folder (one file per partition), quotes escaped by doubling."""
    # the CSV writer trims blanks around values by default; text columns keep them here
    (df.write.mode(mode).option("header", header).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_pages(df: DataFrame, path: str, order, page_size: int = 500, pages_per_file: int = 2000) -> str:
    """Land rows as JSON pages of at most ``page_size`` rows in order, and index them.

    ``<path>/pages`` holds JSON lines, one page a line: its number (from 1), the position of
    its first row and its rows. Files hold neighbouring pages, ``pages_per_file`` at most, so
    neither folders nor files grow with the number of pages alone. Files are compressed
    (field names make most of a line). See ``index_pages``.
    """
    from comboscore.operators.ordinal import with_ordinal
    o = with_ordinal(df, order, "_pos")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    pages = (o.groupBy(F.floor(F.col("_pos") / page_size).cast("long").alias("_p"))
             .agg(F.array_sort(F.collect_list(F.struct("_pos", row.alias("_r")))).alias("_s"))
             .select((F.col("_p") + 1).alias("page"), (F.col("_p") * page_size).alias("first_row"),
                     F.transform("_s", lambda x: x["_r"]).alias("rows")))
    (pages.repartitionByRange("page").sortWithinPartitions("page")
     .write.mode("overwrite").option("maxRecordsPerFile", pages_per_file).option("compression", "gzip")
     .json(f"{path}/pages"))
    index_pages(df.sparkSession, path)
    return path


def index_pages(spark: SparkSession, path: str) -> str:
    """Write ``<path>/index``: (page, first_row, file) for every page of ``<path>/pages``, in page
    order, so a read of the first rows prunes the index by its own row-group statistics."""
    lines = spark.read.schema("page long, first_row long").json(f"{path}/pages")
    (lines.select("page", "first_row", F.col("_metadata.file_name").alias("file"))
     .repartitionByRange("page").sortWithinPartitions("page").write.mode("overwrite").parquet(f"{path}/index"))
    return path


def read_pages(spark: SparkSession, path: str, schema: T.StructType, n: int | None = None) -> DataFrame:
    """(page, place in the page as ``_pos``, the row's columns) of landed pages; with ``n`` the first
    ``n`` rows only.

    The first rows are found through the index: only the files that hold them are opened, and a
    row's position is its page's first row plus its place, so nothing is numbered or sorted. The
    driver sees the names of those files (one for ``page_size * pages_per_file`` rows asked for,
    or one for each task of the writer, whichever is more).
    """
    page = T.StructType([T.StructField("page", T.LongType()), T.StructField("first_row", T.LongType()),
                         T.StructField("rows", T.ArrayType(schema))])
    files = [f"{path}/pages"]
    if n is not None:
        index = spark.read.schema("page long, first_row long, file string").parquet(f"{path}/index")
        files = [f"{path}/pages/{r.file}" for r in index.where(F.col("first_row") < n).select("file").distinct().collect()]
        if not files:
            return spark.createDataFrame([], T.StructType([page["page"], T.StructField("_pos", T.IntegerType()), *schema]))
    rows = spark.read.schema(page).json(files).select("page", "first_row", F.posexplode("rows").alias("_pos", "_r"))
    if n is not None:
        rows = rows.where(F.col("first_row") + F.col("_pos") < n)
    return rows.select("page", "_pos", "_r.*")


def write_adjacency(adj: DataFrame, path: str) -> str:
    """One JSON object per line, ids as text: {"id": "...", "neighbours": ["...", ...]}, or with a
    "block" number for an adjacency in blocks (no line is as long as a hub's degree)."""
    block = ["block"] if "block" in adj.columns else []
    (adj.select(F.col("id").cast("string").alias("id"), *block,
                F.transform("neighbours", lambda x: x.cast("string")).alias("neighbours"))
     .write.mode("overwrite").json(path))
    return path


def read_adjacency(spark: SparkSession, path: str, single_object: bool = False, in_blocks: bool = False) -> DataFrame:
    """(id INT, neighbours ARRAY<INT>) from JSON lines, or from one JSON object per file
    (``single_object``; such a file cannot be split and is read whole by one task).
    ``in_blocks``: lines of (id, block, neighbours), as ``write_adjacency`` lands blocks."""
    if single_object:
        raw = spark.read.text(path, wholetext=True)
        m = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "v"))
        df = m.select(F.col("k").alias("id"), F.col("v").alias("neighbours"))
    else:
        df = spark.read.schema("id string, block long, neighbours array<string>").json(path)
    return df.select(F.col("id").cast("int").alias("id"), *(["block"] if in_blocks else []),
                     F.transform("neighbours", lambda x: x.cast("int")).alias("neighbours"))
