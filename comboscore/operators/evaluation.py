"""Label extraction results -> accuracy, confusion counts, weighted precision/recall/F1.

All metrics come from one grouped count over (truth, pred). That table has at most
|labels|^2 rows however large the input is, so every later step works on a bounded table
and the only pass over the data is a partial-aggregated count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.functions.text import NO_PRED


def pair_counts(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("c"))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred",
                          none_label: str = NO_PRED) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 (support-weighted, 0 on zero division),
    tp, tn, fp, fn (tp: equal and truth != none; tn: equal and truth == none; fp: unequal
    and pred != none; fn: unequal and pred == none).

    One chain over the (truth, pred) counts: each count row is emitted once under its
    truth label (support, hits and the confusion contributions) and once under its
    predicted label (predictions), then folded per label and finally into one row.
    """
    pc = pair_counts(df, truth, pred)
    eq = F.col("truth") == F.col("pred")
    c = F.col("c")
    zero = F.lit(0).cast("long")

    def part(label, support, npred, tp, correct, tpc, tnc, fpc, fnc):
        return F.struct(label.alias("label"), support.alias("support"), npred.alias("npred"), tp.alias("tp"),
                        correct.alias("correct"), tpc.alias("tpc"), tnc.alias("tnc"), fpc.alias("fpc"),
                        fnc.alias("fnc"))

    def when(cond):
        return F.when(cond, c).otherwise(zero)

    as_truth = part(F.col("truth"), c, zero, when(eq), when(eq),
                    when(eq & (F.col("truth") != none_label)), when(eq & (F.col("truth") == none_label)),
                    when(~eq & (F.col("pred") != none_label)), when(~eq & (F.col("pred") == none_label)))
    as_pred = part(F.col("pred"), zero, c, zero, zero, zero, zero, zero, zero)
    sums = ["support", "npred", "tp", "correct", "tpc", "tnc", "fpc", "fnc"]
    per_label = (pc.select(F.explode(F.array(as_truth, as_pred)).alias("r")).select("r.*")
                 .groupBy("label").agg(*[F.sum(k).alias(k) for k in sums]))
    sup, npred, tp = F.col("support"), F.col("npred"), F.col("tp")
    one = per_label.agg(
        F.sum(sup).alias("n"),
        F.sum(_safe_div(tp, npred) * sup).alias("wp"),
        F.sum(_safe_div(tp, sup) * sup).alias("wr"),
        F.sum(_safe_div(2 * tp, sup + npred) * sup).alias("wf"),
        *[F.sum(k).alias(k) for k in ("correct", "tpc", "tnc", "fpc", "fnc")])
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return one.select(
        n.alias("n"),
        _safe_div(F.col("correct"), n).alias("accuracy"),
        _safe_div(F.col("wp"), n).alias("precision"),
        _safe_div(F.col("wr"), n).alias("recall"),
        _safe_div(F.col("wf"), n).alias("f1"),
        *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(name)
          for k, name in (("tpc", "tp"), ("tnc", "tn"), ("fpc", "fp"), ("fnc", "fn"))])


def metric_report(report: DataFrame, digits: dict | None = None) -> DataFrame:
    """Long form (metric, value, digits) of a one-row metrics table."""
    digits = digits or {}
    cols = report.columns
    stacked = report.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"),
                 F.lit(digits.get(c, 2)).alias("digits")) for c in cols])).alias("m"))
    return stacked.select("m.*")


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), F.col(col)))
