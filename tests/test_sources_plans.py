"""File round trips, the entry contract and physical-plan checks."""

import os

from pyspark.sql import functions as F

from comboscore.sources import files as S

SF001 = "/root/testdata/sf0.001"


def test_csv_round_trip_keeps_blanks_quotes_newlines(spark):
    rows = [(1, "ends with blank ", 'has "quotes", commas'), (2, "multi\nline", "")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    path = S.write_table(df, S.landing_dir(spark, "t"))
    back = S.read_table(spark, path, "k long, a string, b string", multiline=True)
    # an empty field reads back as NULL (as pandas reads it as NaN)
    assert sorted(map(tuple, back.collect())) == [(1, "ends with blank ", 'has "quotes", commas'),
                                                   (2, "multi\nline", None)]


def test_padded_and_headerless(spark):
    path = S.landing_dir(spark, "pad")
    os.makedirs(path)
    with open(os.path.join(path, "x.csv"), "w") as f:
        f.write('synergistic, synergistic, "Good, strong."\nantagonistic, additive, "Bad."\n')
    got = S.read_table(spark, path, "Answer string, Truth string, Reasoning string", header=False,
                       strip=True).collect()
    assert [tuple(r) for r in got] == [("synergistic", "synergistic", "Good, strong."),
                                       ("antagonistic", "additive", "Bad.")]
    h = S.read_headerless(spark, path, ["a", "b", "c"]).collect()
    assert len(h) == 2


def test_pages_first_n_in_order(spark):
    df = spark.range(1234).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    path = S.write_pages(df, S.landing_dir(spark, "pages"), "k", page_size=500)
    back = S.read_pages(spark, path, df.schema, n=777)
    rows = back.collect()
    assert sorted(r.k for r in rows) == list(range(777))
    assert {r.page for r in rows} == {1, 2}


def test_pages_share_files_and_first_rows_open_few_of_them(spark):
    df = spark.range(1234).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).alias("odd"),
                                  F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"))
    path = S.write_pages(df, S.landing_dir(spark, "pages"), "k", page_size=10, pages_per_file=4)
    index = spark.read.parquet(f"{path}/index").collect()
    assert sorted((r.page, r.first_row) for r in index) == [(p + 1, p * 10) for p in range(124)]
    per_file = {}
    for r in index:
        per_file.setdefault(r.file, []).append(r.page)
    assert max(map(len, per_file.values())) <= 4 and all(max(p) - min(p) == len(p) - 1 for p in per_file.values())
    whole = sorted(map(tuple, df.collect()))
    for n in (0, 1, 10, 95, 1234, 5000):
        back = S.read_pages(spark, path, df.schema, n=n)
        assert back.columns == ["page", "_pos", "k", "odd", "s"]
        assert sorted(map(tuple, back.drop("page", "_pos").collect())) == whole[:n]
        assert len(back.inputFiles()) <= n // 10 + 1
    assert S.read_pages(spark, path, df.schema).count() == 1234
    none = S.write_pages(df.where("k < 0"), S.landing_dir(spark, "pages"), "k")
    assert S.read_pages(spark, none, df.schema, n=3).count() == 0


def test_file_order_over_many_files_and_blocks(spark):
    from comboscore.operators.ordinal import with_ordinal
    from comboscore.operators.pairs import dedup_pairs
    base = S.landing_dir(spark, "order")
    first, second = f"{base}/z_first", f"{base}/a_second"     # the list decides, not the folder's name
    rows = [(k, (k * 37) % 50) for k in range(4000)]
    for path, part in ((first, rows[:3000]), (second, rows[3000:])):
        os.makedirs(path)
        for f in range(0, len(part), 600):
            with open(os.path.join(path, f"part-{f:05d}.csv"), "w") as out:
                out.write("k,v\n" + "".join(f"{k},{v}\n" for k, v in part[f:f + 600]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "64kb", old):                  # blocks of a file, single files, all in one task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = S.read_shards(spark, [first, second], ["k long, v long"] * 2, with_order=True)
            got = with_ordinal(read, S.ORDER, "row").select("row", "k").collect()
            assert sorted(map(tuple, got)) == [(k, k) for k, _ in rows], size
            pairs = read.select(F.col("v").alias("id_a"), (F.col("v") + 100).alias("id_b"), "k", S.ORDER)
            for keep, want in (("first", min), ("last", max)):
                kept = {r.id_a: r.k for r in dedup_pairs(pairs, [S.ORDER], keep=keep).collect()}
                assert kept == {v: want(k for k, x in rows if x == v) for v in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_adjacency_json_forms(spark):
    adj = spark.createDataFrame([(1, [2, 3]), (2, [1])], "id int, neighbours array<int>")
    path = S.write_adjacency(adj, S.landing_dir(spark, "adj"))
    assert sorted(map(tuple, S.read_adjacency(spark, path).collect())) == [(1, [2, 3]), (2, [1])]
    one = S.landing_dir(spark, "adj1")
    os.makedirs(one)
    with open(os.path.join(one, "a.json"), "w") as f:
        f.write('{"1": ["2", "3"],\n "2": ["1"]}')
    got = sorted(map(tuple, S.read_adjacency(spark, one, single_object=True).collect()))
    assert got == [(1, [2, 3]), (2, [1])]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["combo_id", "drugs", "prediction", "reasoning", "n_pairs", "missing_pairs",
                          "synergistic", "additive"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def _plan(df):
    """The text ``df.explain("formatted")`` prints."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_plan_has_no_cartesian_and_prunes(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["combo_verdict"](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the scan reads only the columns the query uses
    assert ("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,"
            "l_extendedprice:double>") in plan
    assert "l_shipdate" not in plan and "l_linestatus" not in plan


def test_labels_and_prompts_share_one_lookup_and_one_aggregate(spark):
    import re
    import __spark_entry__ as E
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # the form of a lookup beyond a broadcast
    try:
        plan = _plan(E.queries()["key_assign_growing"](spark, SF001)).split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tree = plan.split("\n\n")[0]
    assert len(re.findall(r"\bSortMergeJoin\b", tree)) == 1
    assert "BroadcastHashJoin" not in tree and "CartesianProduct" not in tree


def test_filters_reach_the_scan(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["label_mask"](spark, SF001))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan


def test_no_registered_query_plans_a_cartesian_product(spark):
    import __spark_entry__ as E
    # the oracle SQL may self-join; the Spark plans never pair rows without a key
    for name in ("combo_verdict", "key_assign", "sample_cliques", "silhouette_points", "fixed_blocks",
                 "candidate_except", "weighted_prf", "corpus_bleu", "random_split"):
        plan = _plan(E.queries()[name](spark, SF001))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_oracle_subset_matches(spark):
    import sys
    sys.path.insert(0, os.path.dirname(__file__))
    import oracle_check as OC
    import __spark_entry__ as E
    con = OC.duck(SF001)
    qs, sqls = E.queries(), E.oracle_sql()
    for name in ("combo_verdict", "render_prompt", "perturb_names", "weighted_prf", "rouge1", "corpus_bleu",
                 "sample_cliques", "silhouette_samples", "fixed_blocks", "key_assign_growing", "paged_first_n", "random_split"):
        r = OC.compare(spark, name, qs[name], sqls[name], SF001, con)
        assert r["ok"], r


def test_stream_labels_match_batch(spark):
    from comboscore.functions.text import keyword_label
    from comboscore.streaming.labels import label_stream, run_file_stream
    src = S.landing_dir(spark, "answers")
    df = spark.createDataFrame([(1, "first line\nThe outcome is Additive"), (2, "Synergistic only"),
                                (3, "nothing")], "k long, text string")
    df.write.parquet(src)
    out = spark.read.parquet(run_file_stream(spark, src, df.schema, lambda s: label_stream(s, "k", "text")))
    assert sorted(map(tuple, out.collect())) == [(1, "additive"), (2, "synergistic"), (3, "no_pred")]
    assert keyword_label is not None


def test_caller_functions(spark):
    from comboscore.operators.batch import map_batches, map_column
    df = spark.createDataFrame([(1, "abc"), (2, None)], "k long, s string")
    assert sorted(map(tuple, df.select("k", map_column("s", str.upper).alias("u")).collect())) == [
        (1, "ABC"), (2, None)]
    out = map_batches(df, lambda b: b.assign(n=b["s"].str.len().fillna(0).astype("int64")), "k long, s string, n long")
    assert sorted(map(tuple, out.collect())) == [(1, "abc", 3), (2, None, 0)]
