"""The two evaluator configurations, by hand."""

import pytest

from comboscore.operators.evaluator import Evaluator, evaluate, paired

REFS = [(1, "Additive", "p says synergistic here"), (2, "Synergistic", "p two"), (3, "Additive", "p three")]
ANSWERS = [(10, "additive\nIt is synergistic"), (20, "no idea")]


def tables(spark):
    return (spark.createDataFrame(REFS, "k int, prediction string, prompt string"),
            spark.createDataFrame(ANSWERS, "a int, response string"))


def report(df):
    return {r.metric: (r.value, r.text) for r in df.collect()}


def test_label_evaluator_cuts_to_the_shorter_table(spark):
    rows = paired(*tables(spark), "k", "a", "response", Evaluator())
    assert [(r.truth, r.pred, r.rouge_text) for r in rows.orderBy("ordinal").collect()] == [
        ("additive", "synergistic", "synergistic"), ("synergistic", "no_pred", "no_pred")]
    got = report(evaluate(rows, stem=False))
    assert got["accuracy"] == (0.0, "0.00") and got["fp"] == (1.0, "1") and got["fn"] == (1.0, "1")
    # "synergistic" against the four words of the first prompt: p = 1, r = 1/4; second row: no hit
    assert got["rouge1"][0] == pytest.approx(0.4 / 2) and got["rouge1"][1] == "0.2000" == got["rougeL"][1]


def test_text_evaluator_strips_the_first_line_and_takes_the_first_rows(spark):
    how = Evaluator(truth="prompt", first_n=1, strip_first=True, rouge_on="response")
    rows = paired(*tables(spark), "k", "a", "response", how)
    assert [(r.truth, r.pred, r.response) for r in rows.collect()] == [("synergistic", "synergistic", "It is synergistic")]
    got = report(evaluate(rows, stem=False))
    assert got["accuracy"] == (1.0, "1.00") and got["tp"] == (1.0, "1")
    assert got["rouge1"][0] == pytest.approx(2 * (1 / 3) * (1 / 4) / (1 / 3 + 1 / 4))


def test_empty_report_and_bad_setting(spark):
    refs, answers = tables(spark)
    got = report(evaluate(paired(refs, answers.limit(0), "k", "a", "response", Evaluator())))
    assert got["bleu"] == (0.0, "0.0000") and got["rougeL"][0] == 0.0 and got["accuracy"][0] == 0.0
    with pytest.raises(ValueError):
        paired(refs, answers, "k", "a", "response", Evaluator(rouge_on="words"))
