"""Row positions, splits and alignment."""

import pytest
from pyspark.sql import functions as F

from comboscore.operators.ordinal import (align, batches, contiguous_split, head, random_split, slice_rows,
                                          tail, with_ordinal)


def shuffled(spark, n, parts=7):
    return spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(parts)


def test_with_ordinal_is_dense_rank(spark):
    for parts in (1, 5, 13):
        df = with_ordinal(shuffled(spark, 1000, parts), "k", total="n")
        rows = df.collect()
        assert sorted((r.k, r.ordinal) for r in rows) == [(i, i) for i in range(1000)]
        assert {r.n for r in rows} == {1000}


def test_with_ordinal_descending_and_ties(spark):
    df = spark.createDataFrame([(1,), (3,), (3,), (2,)], "v int")
    o = with_ordinal(df, [F.col("v").desc()]).orderBy("ordinal").collect()
    assert [r.v for r in o] == [3, 3, 2, 1] and [r.ordinal for r in o] == [0, 1, 2, 3]


def test_contiguous_split_sizes(spark):
    # 9,539 rows -> test 1,000 / train int(0.9 * 8,539) = 7,685 / eval 854
    s = contiguous_split(spark.range(9539).withColumnRenamed("id", "k"), "k")
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"test": 1000, "train": 7685, "eval": 854}
    firsts = s.where("split = 'test'").agg(F.max("k")).first()[0]
    assert firsts == 999


def test_random_split_exact_sizes_and_seeded(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = random_split(df, "k", seed=7)
    got = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert got == {"train": 80, "valid": 10, "test": 10}
    b = random_split(df.repartition(9), "k", seed=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    c = random_split(df, "k", seed=8)
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, c.collect()))


def test_head_tail_slice(spark):
    df = shuffled(spark, 50)
    assert [r.k for r in head(df, 3, "k").collect()] == [0, 1, 2]
    assert sorted(r.k for r in tail(df, 3, "k").collect()) == [47, 48, 49]
    assert sorted(r.k for r in slice_rows(df, 45, 10, "k").collect()) == [45, 46, 47, 48, 49]


def test_batches(spark):
    b = batches(shuffled(spark, 20), "k", 8)
    assert {r.k: r.batch_id for r in b.collect()} == {i: i // 8 for i in range(20)}


def test_align_truncates_or_keeps_left(spark):
    left = spark.range(5).select(F.col("id").alias("a"))
    right = spark.range(3).select((F.col("id") + 100).alias("b"))
    inner = sorted((r.ordinal, r.a, r.b) for r in align(left, right, "a", "b").collect())
    assert inner == [(0, 0, 100), (1, 1, 101), (2, 2, 102)]
    lj = sorted((r.ordinal, r.b) for r in align(left, right, "a", "b", how="left").collect())
    assert lj == [(0, 100), (1, 101), (2, 102), (3, None), (4, None)]
    assert len(align(left, right, "a", "b", n=2).collect()) == 2


def test_head_and_tail_take_one_path(spark):
    df = shuffled(spark, 50)
    for n in (0, 7, 50, 500):
        assert [r.k for r in head(df, n, "k").collect()] == list(range(min(n, 50)))
        assert [r.k for r in tail(df, n, "k").collect()] == list(range(49, 49 - min(n, 50), -1))


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"},
                                  {"spark.sql.adaptive.enabled": "false"}])
def test_wide_rows_keep_every_position(spark, tmp_path, conf):
    """Written out, as a count would prune the payload."""
    n = 400_000
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("payload"))
        with_ordinal(df, "k", "pos").write.parquet(str(tmp_path / "out"))
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    out = spark.read.parquet(str(tmp_path / "out"))
    row = out.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.sum((F.col("pos") != F.col("k")).cast("int"))).first()
    assert tuple(row) == (n, n, 0, n - 1, 0)


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from comboscore.session import checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        checkpoint_dir(cluster)
