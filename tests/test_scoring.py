"""Pair lookup, sticky flag, vote and verdict on hand-made tables."""

from pyspark.sql import functions as F

from comboscore.operators.pairs import combo_pairs, dedup_pairs, lookup_pairs
from comboscore.operators.prompts import dedup_combo_key, render_prompts
from comboscore.operators.scoring import combo_verdict, score_pairs

SCORES = "ord int, id_a int, id_b int, name_a string, name_b string, bliss double, loewe double, hsa double, zip double, loewe_text string"


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES)


def verdict(spark, combos, score_rows, keep="first"):
    c = spark.createDataFrame(combos, "combo_id long, ids array<int>")
    lk = lookup_pairs(combo_pairs(c), scores(spark, score_rows), order=["ord"], keep=keep,
                      columns=["name_a", "name_b", "bliss", "loewe", "hsa", "zip"])
    sc = score_pairs(lk)
    return sc, combo_verdict(sc)


def test_dedup_first_and_last_either_orientation(spark):
    rows = [(1, 2, 1, "B", "A", 0.0, 0.5, 0.0, 1.0, "0.5"),
            (2, 1, 2, "A", "B", 0.0, -0.5, 0.0, 1.0, "-0.5"),
            (3, 3, 1, "C", "A", 0.0, 0.0, 0.0, 1.0, "0.0")]
    d = {(r.id_lo, r.id_hi): r for r in dedup_pairs(scores(spark, rows), ["ord"]).collect()}
    assert d[(1, 2)].ord == 1 and d[(1, 2)].name_a == "B"      # stored orientation kept
    dl = {(r.id_lo, r.id_hi): r for r in dedup_pairs(scores(spark, rows), ["ord"], keep="last").collect()}
    assert dl[(1, 2)].ord == 2 and dl[(1, 3)].ord == 3


def test_sticky_flag_and_verdict(spark):
    # pairs in order (0,1)=(1,2), (0,2)=(1,3), (1,2)=(2,3)
    rows = [(1, 1, 2, "A", "B", 0.0, 0.0, 0.0, -2.0, "0.0"),     # zip < -1 sets the flag
            (2, 1, 3, "A", "C", 0.5, -0.5, 0.5, 1.0, "-0.5"),    # all synergistic, but flag is sticky
            (3, 3, 2, "C", "B", 0.0, 0.0, 0.0, 16.0, "0.0")]     # highly synergistic stays Synergistic
    sc, v = verdict(spark, [(10, [1, 2, 3])], rows)
    labels = [r.pair_label for r in sc.orderBy("i", "j").collect()]
    assert labels == ["Antagonistic", "Antagonistic", "Synergistic"]
    r = v.first()
    assert r.prediction == "Antagonistic"
    assert r.reasoning == ("A and B are antagonistic. A and C are antagonistic. "
                           "C and B are highly synergistic. ")
    assert (r.synergistic, r.additive, r.n_pairs, r.missing_pairs) == (1, 0, 3, 0)


def test_flag_not_set_before_it_happens(spark):
    rows = [(1, 1, 2, "A", "B", 0.5, -0.5, 0.5, 1.0, "-0.5"),
            (2, 1, 3, "A", "C", 0.0, 0.0, 0.0, -0.5, "0.0"),     # -1 < zip < 0: no flag
            (3, 2, 3, "B", "C", 0.0, 0.0, 0.0, -1.5, "0.0")]
    sc, v = verdict(spark, [(1, [1, 2, 3])], rows)
    got = [(r.pair_label, r.sticky) for r in sc.orderBy("i", "j").collect()]
    assert got == [("Synergistic", False), ("Additive", False), ("Antagonistic", True)]
    assert v.first().prediction == "Antagonistic"


def test_verdict_rules_and_missing(spark):
    rows = [(1, 1, 2, "A", "B", 0.0, 0.0, 0.0, 16.0, "0.0"),
            (2, 3, 4, "C", "D", 0.0, 0.0, 0.0, -0.5, "0.0")]
    _, v = verdict(spark, [(1, [1, 2]), (2, [3, 4]), (3, [1, 2, 5]), (4, [5, 6])], rows)
    got = {r.combo_id: (r.prediction, r.missing_pairs) for r in v.collect()}
    assert got == {1: ("Synergistic", 0), 2: ("Additive", 0), 3: ("Synergistic", 2), 4: (None, 1)}


def test_all_differ_sentence_keeps_capital(spark):
    rows = [(1, 1, 2, "A", "B", 0.5, 0.5, 0.0, 1.0, "0.5")]
    _, v = verdict(spark, [(1, [1, 2])], rows)
    assert v.first().reasoning == "A and B are Antagonistic. "


def test_prompt_rendering(spark):
    rows = [(1, 2, 1, "B", "A", 0.0, 0.5, 0.0, 1.0, "0.5"),
            (2, 1, 2, "A", "B", 0.0, -0.5, 0.0, 1.0, "-0.5"),     # last wins for prompts
            (3, 3, 1, "C", "A", 0.0, 0.1, 0.0, 1.0, "0.1")]
    c = spark.createDataFrame([(1, [2, 1, 3]), (2, [7, 8])], "combo_id long, ids array<int>")
    lk = lookup_pairs(combo_pairs(c), scores(spark, rows), order=["ord"], keep="last",
                      columns=["name_a", "name_b", "loewe_text"])
    p = {r.combo_id: r for r in render_prompts(lk).collect()}
    assert p[1].context == ("Context: A and B have a Loewe score of: -0.5. "
                            "C and A have a Loewe score of: 0.1.")
    assert p[1].names == "A, B, C"
    assert p[1].prompt.startswith(p[1].context + "  The drug combination to analyze is: A, B, C . According")
    assert p[2].context == "Context: " and p[2].names == ""


def test_dedup_combo_key(spark):
    df = spark.createDataFrame([(5, "1, 2", "Additive", "r5"), (9, "1, 2", "Synergistic", "r9"),
                                (7, "2, 1", "Antagonistic", "r7")],
                               "combo_id long, drugs string, prediction string, reasoning string")
    got = {r.drugs: (r.first_combo_id, r.prediction) for r in dedup_combo_key(df).collect()}
    assert got == {"1, 2": (5, "Synergistic"), "2, 1": (7, "Antagonistic")}


def test_partition_count_does_not_change_verdicts(spark):
    import __spark_entry__ as E
    q = E.queries()["combo_verdict"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) > 0


def test_swapping_orientation_changes_no_verdict(spark):
    rows = [(1, 1, 2, "A", "B", 0.5, -0.5, 0.0, -3.0, "-0.5"), (2, 2, 3, "B", "C", 0.0, 0.2, 0.3, 2.0, "0.2"),
            (3, 1, 3, "A", "C", 0.3, 0.0, -0.3, 20.0, "0.0")]
    swapped = [(o, b, a, nb, na, *rest) for (o, a, b, na, nb, *rest) in rows]
    _, v1 = verdict(spark, [(1, [1, 2, 3]), (2, [3, 1])], rows)
    _, v2 = verdict(spark, [(1, [1, 2, 3]), (2, [3, 1])], swapped)
    p1 = sorted((r.combo_id, r.prediction) for r in v1.collect())
    p2 = sorted((r.combo_id, r.prediction) for r in v2.collect())
    assert p1 == p2
    assert F is not None


def test_hot_pair(spark):
    """One pair holds a third of all score rows; combinations reuse it and the cold pairs."""
    hot = [(i, 1, 2, "A", "B", 0.0, 0.0, 0.0, float(i % 3) - 3.0, "0.0") for i in range(300)]
    cold = [(1000 + i, 3 + i % 50, 60 + i % 40, "X", "Y", 0.5, -0.5, 0.5, 1.0, "-0.5") for i in range(600)]
    d = {(r.id_lo, r.id_hi): r for r in dedup_pairs(scores(spark, hot + cold), ["ord"]).collect()}
    assert d[(1, 2)].ord == 0 and d[(1, 2)].zip == -3.0
    dl = {(r.id_lo, r.id_hi): r for r in dedup_pairs(scores(spark, hot + cold), ["ord"], keep="last").collect()}
    assert dl[(1, 2)].ord == 299
    combos = [(7, [1, 2])] * 1 + [(100 + i, [3 + i % 50, 60 + i % 40]) for i in range(40)]
    _, v = verdict(spark, combos, hot + cold)
    got = {r.combo_id: r.prediction for r in v.collect()}
    # combo 7: first hot row has zip -3 < -1; combo 100: pair (3, 60) is all-synergistic but zip 1
    assert got[7] == "Antagonistic" and got[100] == "Additive" and len(got) == 41


def test_one_aggregate_gives_the_verdicts_and_prompts_of_two(spark):
    from comboscore.operators.pairs import combo_pairs, join_both, join_pairs, pair_table
    from comboscore.operators.prompts import labelled_prompts, render_prompts
    from comboscore.operators.scoring import combo_verdict, score_pairs
    scores = spark.createDataFrame(
        [(0, 1, 2, "A", "B", 1.0, 0.5, 0.0, 20.0, "0.5"), (1, 2, 1, "B2", "A2", -1.0, -0.5, 0.0, -2.0, "-0.5"),
         (2, 2, 3, "B", "C", 0.0, float("nan"), None, 3.0, "nan"), (3, 4, 5, "D", "E", 0.0, 0.0, 0.0, 0.0, "0.0")],
        "o int, id_a int, id_b int, name_a string, name_b string, bliss double, loewe double, hsa double, "
        "zip double, loewe_text string")
    combos = spark.createDataFrame([(1, [1, 2, 3], "x"), (2, [3, 2], "y"), (3, [7, 8], "z"), (4, [5, 4, 1], "w")],
                                   "combo_id long, ids array<int>, drugs string")
    columns = ["name_a", "name_b", "bliss", "loewe", "hsa", "zip", "loewe_text"]
    table = pair_table(scores, ["o"], columns)
    pairs = combo_pairs(combos, keep=("drugs",))
    both = labelled_prompts(join_both(pairs, table, columns[:-1], ["name_a", "name_b", "loewe_text"]), carry=("drugs",))
    verdicts = combo_verdict(score_pairs(join_pairs(pairs, table, columns=columns[:-1])), carry=("drugs",))
    prompts = render_prompts(join_pairs(pairs, table, keep="last"))
    want = verdicts.join(prompts, "combo_id").select(*both.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))
    assert {r.combo_id: (r.prediction, r.names) for r in both.collect()} == {
        1: ("Synergistic", "A2, B, B2, C"), 2: ("Additive", "B, C"), 3: (None, ""), 4: ("Additive", "D, E")}
