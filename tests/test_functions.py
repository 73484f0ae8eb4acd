"""Column functions against hand-computed values."""

from pyspark.sql import functions as F

from comboscore.functions import classify as C
from comboscore.functions import text as T
from comboscore.functions.pairs import index_pairs, join_ids, parse_ids


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k int, v {typ}")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v"))).collect()]


def test_swap_middle(spark):
    words = ["abcd", "abcde", "ab", "a", "", "Drug-12"]
    # even: swap (mid-1, mid); odd: swap (mid, mid+1); length <= 1 unchanged
    assert one_col(spark, words, T.swap_middle) == ["acbd", "abdce", "ba", "a", "", "Dru-g12"]


def test_drop_last(spark):
    assert one_col(spark, ["abc", "a", ""], T.drop_last) == ["ab", "", ""]


def test_perturb_names(spark):
    p = ("Context: A and B have a Loewe score of: 0.1.  The drug combination to analyze is: "
         "Drug-12, Drug-7 . According to the rule, if Loewe > 0.1, stop.")
    df = spark.createDataFrame([(p, True), (p, False), ("no marker here.", True)], "p string, s boolean")
    out = [r[0] for r in df.select(T.perturb_names(F.col("p"), F.col("s"))).collect()]
    head = "Context: A and B have a Loewe score of: 0.1.  The drug combination to analyze is: "
    tail = ". According to the rule, if Loewe > 0.1, stop."
    assert out[0] == head + "Dru-g12, Drgu-7" + tail
    assert out[1] == head + "Drug-1, Drug-" + tail
    assert out[2] == "no marker here."


def test_keyword_label(spark):
    texts = ["Very ANTAGONISTIC and synergistic", "it is additive.", "Synergistic!", "", None]
    assert one_col(spark, texts, T.keyword_label) == [
        "antagonistic", "additive", "synergistic", "no_pred", "no_pred"]


def test_strip_first_line(spark):
    assert one_col(spark, ["a\nb\nc", "abc", "\nx"], T.strip_first_line) == ["b\nc", "abc", "x"]


def test_decimal_text(spark):
    vals = [0.1, -0.0422, 2.0, 0.0001, -0.5, 0.0, 4.0617]
    assert one_col(spark, vals, T.decimal_text, "double") == [
        "0.1", "-0.0422", "2.0", "0.0001", "-0.5", "0.0", "4.0617"]


def test_extract_names(spark):
    p = "x  The drug combination to analyze is: Drug-1, Drug-2 . According to the rule"
    assert one_col(spark, [p, "nothing"], T.extract_names) == ["Drug-1, Drug-2 ", ""]


def test_tokens(spark):
    assert one_col(spark, [" a  b\n c ", ""], T.ws_tokens) == [["a", "b", "c"], []]
    assert one_col(spark, ["Hello, World! 42x", "--"], T.rouge_tokens) == [["hello", "world", "42x"], []]
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    r = df.select(T.ngrams("t", 2).alias("b"), T.ngrams("t", 4).alias("q")).first()
    assert r.b == ["a b", "b c"] and r.q == []


def test_sentence_split(spark):
    assert one_col(spark, ["a. b..", "x"], T.sentence_split) == [["a", " b", "", ""], ["x"]]


def test_ids(spark):
    df = spark.createDataFrame([(" 3, 1 ,2",)], "s string")
    r = df.select(parse_ids("s").alias("ids")).select("ids", join_ids("ids").alias("j")).first()
    assert r.ids == [3, 1, 2] and r.j == "3, 1, 2"


def test_index_pairs(spark):
    df = spark.createDataFrame([(1, [7, 8, 9]), (2, [5])], "k int, ids array<int>")
    rows = df.select("k", F.inline(index_pairs("ids"))).orderBy("k", "i", "j").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 1, 7, 8), (1, 0, 2, 7, 9), (1, 1, 2, 8, 9)]


def test_classifiers(spark):
    vals = [0.1, 0.1001, -0.1, -0.2, None, float("nan")]
    assert one_col(spark, vals, lambda c: C.classify_bliss(C.nan_to_null(c)), "double") == [
        "Additive", "Synergistic", "Additive", "Antagonistic", "Additive", "Additive"]
    assert one_col(spark, vals, lambda c: C.classify_loewe(C.nan_to_null(c)), "double") == [
        "Additive", "Antagonistic", "Additive", "Synergistic", "Additive", "Additive"]
    z = [16.0, 15.0, -15.5, -15.0, 0.0, 3.0, None]
    assert one_col(spark, z, C.classify_zip, "double") == [
        "Highly Synergistic", "Synergistic", "Highly Antagonistic", "Antagonistic", "Additive",
        "Synergistic", "Additive"]


def test_pair_vote(spark):
    # (bliss, loewe, hsa, zip, sticky) -> (label, word)
    rows = [
        (0.5, 0.5, 0.5, 16.0, True, "Synergistic", "highly synergistic"),     # zip first, beats flag
        (0.5, -0.5, 0.5, -16.0, False, "Antagonistic", "highly antagonistic"),
        (0.5, -0.5, 0.5, 1.0, True, "Antagonistic", "antagonistic"),         # sticky flag
        (-0.5, 0.5, 0.0, 1.0, False, "Antagonistic", "antagonistic"),        # two antagonistic
        (0.5, -0.5, 0.0, 1.0, False, "Synergistic", "synergistic"),
        (0.0, 0.0, 0.5, 1.0, False, "Additive", "additive"),
        (0.5, 0.5, 0.0, 1.0, False, "Antagonistic", "Antagonistic"),         # all differ -> Loewe, capital
        (0.5, 0.0, -0.5, 1.0, False, "Additive", "Additive"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "b double, l double, h double, z double, s boolean")
    lab, word = C.pair_vote("b", "l", "h", "z", "s")
    got = [tuple(r) for r in df.select(lab, word).collect()]
    assert got == [(r[5], r[6]) for r in rows]
