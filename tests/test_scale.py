"""Steps whose work must grow no faster than the input: plans, task counts and stored rows."""

import contextlib
import io
import re

from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"


def _tree(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue().split("== Initial Plan ==")[-1]


def test_narrow_rows_are_dealt_into_tasks_by_their_number(spark):
    from comboscore.session import ROWS_PER_TASK, deal
    df = spark.range(10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert deal(df, 10, "id").rdd.getNumPartitions() == least
    assert deal(df, ROWS_PER_TASK * (least + 3) + 1, "id").rdd.getNumPartitions() == least + 4


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import glob
    import time

    from comboscore.session import CLEANUP, cut_lineage

    def files():
        return set(glob.glob(spark.conf.get("spark.local.dir") + "/**/shuffle_*.data", recursive=True))
    before, had = files(), spark.conf.get(CLEANUP, None)
    df = spark.range(10000).repartition(7, "id")
    stored = cut_lineage(df)
    stops = time.time() + 10
    while files() - before and time.time() < stops:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) == had and df.count() == stored.count() == 10000


def test_growing_combinations_are_stored_before_their_pairs(spark):
    """The last job shuffles no lines, and the texts of a combination go with its first pair only."""
    import __spark_entry__ as E
    from comboscore.plans import lineage as L
    tree = _tree(E.queries()["key_assign_growing"](spark, SF001))
    assert tree.count("FileScan") == 2 and "l_orderkey" not in tree, tree
    pairs = L.Derived(spark, SF001, growing=True)._first
    assert pairs.where("(drugs is not null) != (i = 0 and j = 1)").count() == 0


def test_large_lists_are_not_walked_by_lambdas(spark):
    import __spark_entry__ as E
    assert "lambdafunction" not in _tree(E.queries()["prompt_blocks"](spark, SF001))
    assert "array_intersect" not in _tree(E.queries()["candidate_blocks"](spark, SF001))
    # one function: stems do not come back to be compared
    assert _tree(E.queries()["evaluate_labels_stemmed"](spark, SF001)).count("ArrowEvalPython") == 1


def test_combinations_are_shuffled_twice_and_never_coalesced(spark):
    """One shuffle by order, one by combination, both with a fixed number of tasks; the window over the
    pairs sorts ids and numbers, no names or score texts."""
    import __spark_entry__ as E
    for name in ("key_assign", "combo_verdict", "combo_verdict_growing"):
        tree = _tree(E.queries()[name](spark, SF001))
        kinds = re.findall(r"Exchange hashpartitioning\([^)]*\), (\w+)", tree)
        assert set(kinds) == {"REPARTITION_BY_NUM"}, (name, kinds)
        assert not re.search(r"Project \[[^\]]*(name_a|loewe_text)#\d+[^\]]*(zip|bliss)#\d+", tree.split("Window")[-1]), name


def test_labels_and_answers_come_from_one_aggregate(spark):
    from comboscore.plans import lineage as L
    for name in ("eval_table", "answered"):
        tree = _tree(getattr(L.Derived(spark, SF001), name))
        assert tree.count("FileScan") == 2, tree     # the lines, the stored pairs


def test_first_positions_number_no_other_rows(spark, monkeypatch):
    from comboscore.operators import ordinal as O
    stored = []
    real = O.cut_lineage
    monkeypatch.setattr(O, "cut_lineage", lambda df: stored.append(real(df)) or stored[-1])
    a = spark.range(1000).select(F.col("id").alias("x"))
    b = spark.range(0, 2000, 2).select(F.col("id").alias("y"))
    got = sorted(map(tuple, O.align(a, b, "x", "y", n=5).collect()))
    assert got == [(k, k, 2 * k) for k in range(5)]
    assert [s.count() for s in stored] == [5, 5]


def test_ngrams_compute_their_tokens_once(spark):
    """The tokens of an expression are bound before the grams, not split again for each of them."""
    from comboscore.functions import text as T
    df = spark.createDataFrame([("a b  c",), ("one",), ("",), (None,)], "t string")
    grams = df.select(T.ngrams(T.ws_tokens("t"), 2).alias("g"))
    assert [r.g for r in grams.collect()] == [["a b", "b c"], [], [], []]
    assert _tree(grams).split("Scan")[0].count("split(") == 1


def test_known_tokens_are_never_rows(spark):
    """With the whole vocabulary in the broadcast no token is exploded or shuffled; repeated and null keys
    are one row by position, as through the tail."""
    from comboscore.operators import blocks as B
    df = spark.createDataFrame([(1, "b a b"), (2, "a"), (2, "c c"), (None, "b"), (3, ""), (4, None)], "k long, text string")
    vocab = spark.createDataFrame([("b", 3, 1), ("a", 2, 2)], "token string, count long, token_id long")
    want = {1: ([1, 2, 1], 3), 2: ([0, 2, 0], 2), None: ([1], 1), 3: ([], 0), 4: ([], None)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (old, "20", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert {r.k: (r.ids, r.n_tokens) for r in B.token_ids(df, "k", "text", vocab).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tree = _tree(B.token_ids(df.where("k = 1 or k = 3"), "k", "text", vocab))
    assert "Generate" not in tree and "Exchange" not in tree


def test_clipped_counts_of_few_and_many_shared_grams(spark):
    from collections import Counter
    from comboscore.operators.textmetrics import FEW, bleu_row_counts, rouge
    long = " ".join(f"w{k % (3 * FEW)}" for k in range(60))
    rows = [("a b a", "a a a c"), (long, long + " w1 w2"), (long, "x y"), ("", "a"), (long, "w1 w3 w1")]
    df = spark.createDataFrame(rows, "r string, c string")
    got = bleu_row_counts(df, "r", "c").collect()
    for row in got:
        for n in range(1, 5):
            grams = [Counter(zip(*(t.split()[k:] for k in range(n)))) for t in (row.r, row.c)]
            assert row.clipped[n - 1] == sum((grams[0] & grams[1]).values())
    for row in rouge(df, "r", "c", kinds=("rouge1",)).collect():
        hit = sum((Counter(row.r.split()) & Counter(row.c.split())).values())
        assert row.rouge1_p == (hit / len(row.c.split()) if row.c else 0.0)
