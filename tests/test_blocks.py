"""Word ids through the head and the tail of a vocabulary, and padding."""

import pytest
from pyspark.sql import functions as F

from comboscore.operators import blocks as B

TEXTS = [(1, "a b a c"), (2, ""), (3, None), (4, "a a a zz"), (5, "b"), (6, "q " * 300)]


def encoded(spark, limit=None):
    df = spark.createDataFrame(TEXTS, "k long, text string")
    vocab = B.vocabulary(df.where("k <> 5"), "text")
    ids = {r.token: r.token_id for r in vocab.collect()}
    return {r.k: (r.ids, r.n_tokens) for r in B.token_ids(df, "k", "text", vocab, limit).collect()}, ids


@pytest.mark.parametrize("threshold", ["10m", "40", "-1"])
def test_ids_do_not_depend_on_the_head(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for limit in (None, 3):
            got, ids = encoded(spark, limit)
            for k, text in TEXTS:
                words = (text or "").split()
                assert got[k][0] == [ids.get(w, 0) for w in words[:limit]]
                assert got[k][1] == (len(words) if text is not None else -1) or text is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pad_batches(spark):
    rows = [(1, 0, [5, 6]), (2, 0, [7]), (3, 1, []), (4, 1, None), (5, 2, [1, 2, 3])]
    df = spark.createDataFrame(rows, "k long, batch_id long, ids array<long>")
    got = {r.k: (r.pad_len, r.ids, r["mask"]) for r in B.pad_batches(df).collect()}
    assert got == {1: (2, [5, 6], [1, 1]), 2: (2, [7, 0], [1, 0]), 3: (0, [], []), 4: (0, [], []), 5: (3, [1, 2, 3], [1, 1, 1])}
    left = {r.k: (r.ids, r["mask"]) for r in B.pad_batches(df, batch=None, side="left", pad_id=9, limit=2).collect()}
    assert left == {1: ([5, 6], [1, 1]), 2: ([9, 7], [0, 1]), 3: ([9, 9], [0, 0]), 4: ([9, 9], [0, 0]), 5: ([1, 2], [1, 1])}
    assert B.pad_batches(df.limit(0), batch=None).collect() == []
    with pytest.raises(ValueError):
        B.pad_batches(df, side="middle")


def test_padded_rows_of_a_batch_are_equally_long(spark):
    df = spark.range(200).select("id", F.floor(F.col("id") / 8).alias("batch_id"), F.sequence(F.lit(0).cast("long"), F.col("id") % 13).alias("ids"))
    got = B.pad_batches(df).groupBy("batch_id").agg(F.min(F.size("ids")).alias("a"), F.max(F.size("ids")).alias("b"), F.max("pad_len").alias("c"))
    assert all(r.a == r.b == r.c for r in got.collect())
