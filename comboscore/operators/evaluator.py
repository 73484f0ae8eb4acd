"""Whole evaluation of model answers: label metrics, ROUGE and BLEU in one long report.

Truth and answers are paired by position first (``ordinal.align``). The paired rows are stored
once, as label counts, ROUGE means and BLEU sums each read them; every later table is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comboscore.functions.text import keyword_label, strip_first_line
from comboscore.operators.evaluation import classification_report, metric_report
from comboscore.operators.ordinal import align
from comboscore.operators.textmetrics import ROUGE_KINDS, corpus_bleu, rouge
from comboscore.session import cut_lineage

COUNTS = ("tp", "tn", "fp", "fn")


@dataclass(frozen=True)
class Evaluator:
    """How answers are judged.

    ``truth``: column of the reference table whose label word is the truth. ``reference``: column
    that ROUGE and BLEU compare with. ``first_n``: pair only the first n positions (None: up to the
    shorter table). ``strip_first``: drop an answer's first line before anything else.
    ``rouge_on``: ROUGE judges the ``"label"`` word or the whole ``"response"``.
    """
    truth: str = "prediction"
    reference: str = "prompt"
    first_n: int | None = None
    strip_first: bool = False
    rouge_on: str = "label"


def paired(refs: DataFrame, answers: DataFrame, ref_order: str, answer_order: str, response: str,
           how: Evaluator) -> DataFrame:
    """(ordinal, truth, pred, reference, rouge_text, response) of the rows paired by position."""
    if how.rouge_on not in ("label", "response"):
        raise ValueError("rouge_on must be 'label' or 'response'")
    left = refs.select(F.col(ref_order).alias("_left"), keyword_label(how.truth).alias("truth"),
                       F.col(how.reference).alias("reference"))
    text = strip_first_line(response) if how.strip_first else F.col(response)
    right = answers.select(F.col(answer_order).alias("_right"), text.alias("response"))
    rows = align(left, right, "_left", "_right", n=how.first_n).withColumn("pred", keyword_label("response"))
    return rows.select("ordinal", "truth", "pred", "reference",
                       F.col("pred" if how.rouge_on == "label" else "response").alias("rouge_text"), "response")


def evaluate(rows: DataFrame, kinds=ROUGE_KINDS, stem: bool = True) -> DataFrame:
    """(metric, value, digits, text) of paired rows; ``text`` is the value as it is printed.

    Metrics: accuracy, precision, recall, f1 (two digits), tp, tn, fp, fn (none), the mean F of each
    ROUGE kind and corpus BLEU (four). Without rows all are 0.
    """
    rows = cut_lineage(rows)
    labels = classification_report(rows).select("accuracy", "precision", "recall", "f1", *COUNTS)
    means = rouge(rows, "reference", "rouge_text", stem=stem, kinds=kinds).agg(
        *[F.coalesce(F.avg(k + "_f"), F.lit(0.0)).alias(k) for k in kinds])
    bleu = corpus_bleu(rows, "reference", "response").select("bleu")
    report = (metric_report(labels, {c: 0 for c in COUNTS})
              .unionByName(metric_report(means, {k: 4 for k in kinds}))
              .unionByName(metric_report(bleu, {"bleu": 4})))
    return report.withColumn("text", _printed(F.col("value"), F.col("digits")))


def _printed(value: Column, digits: Column) -> Column:
    return (F.when(digits == 0, F.format_string("%.0f", value)).when(digits == 2, F.format_string("%.2f", value))
            .otherwise(F.format_string("%.4f", value)))
