"""Missing pairs, sentences of several columns, white space around ids."""

import pytest
from pyspark.sql import functions as F

from comboscore.functions.pairs import parse_ids, strip_ws
from comboscore.functions.text import sentences_of
from comboscore.operators.scoring import combo_verdict, score_pairs


def looked_up(spark):
    rows = [(1, 0, 1, "A", "B", 0.5, 0.5, 0.5, 16.0, True), (1, 0, 2, None, None, None, None, None, None, False),
            (2, 0, 1, "A", "B", 0.0, 0.0, 0.0, -2.0, True)]
    return spark.createDataFrame(rows, "combo_id int, i int, j int, name_a string, name_b string, bliss double, loewe double, hsa double, zip double, found boolean")


def test_on_missing(spark):
    scored = score_pairs(looked_up(spark))
    got = {how: {r.combo_id: (r.prediction, r.reasoning != "", r.missing_pairs) for r in combo_verdict(scored, on_missing=how).collect()}
           for how in ("skip", "null")}
    assert got["skip"] == {1: ("Synergistic", True, 1), 2: ("Antagonistic", True, 0)}
    assert got["null"] == {1: (None, False, 1), 2: ("Antagonistic", True, 0)}
    with pytest.raises(Exception, match="without a score in combination 1"):
        combo_verdict(scored, on_missing="error").collect()
    assert combo_verdict(scored.where("combo_id = 2"), on_missing="error").count() == 1
    with pytest.raises(ValueError):
        combo_verdict(scored, on_missing="drop")


def test_sentences_of_several_columns(spark):
    df = spark.createDataFrame([(1, "a.b", None), (2, "", "x. y.")], "id int, p string, q string")
    got = [tuple(r) for r in df.select("id", F.inline(sentences_of(["p", "q"]))).collect()]
    assert sorted(got) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (2, 0, 0, ""), (2, 1, 0, "x"), (2, 1, 1, " y"), (2, 1, 2, "")]


def test_every_white_space_is_stripped(spark):
    texts = [" 1, 2 ", "\x1c3,\x1f4　", "  5 ,6\n\n", "7\n8"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip_ws("t").alias("s")).collect()] == [t.strip() for t in texts]
    assert [r.s for r in df.where(~F.col("t").contains("7")).select(parse_ids("t").alias("s")).collect()] == [[1, 2], [3, 4], [5, 6]]
