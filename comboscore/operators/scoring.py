"""Four-score pair vote, the sticky antagonism flag and the combination verdict.

Plan shape: the looked-up pairs are windowed by combination (ordered by pair position)
for the sticky flag, then aggregated by the same key — the aggregate reuses the window's
hash partitioning, so scoring costs one shuffle on ``key`` (none extra when the input is
already partitioned by it). A combination has at most C(5, 2) = 10 pairs, so every group
is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comboscore.functions import classify as C


def score_pairs(looked_up: DataFrame, key: str = "combo_id", order=("i", "j"),
                name_a: str | Column = "name_a", name_b: str | Column = "name_b") -> DataFrame:
    """Per pair: the four labels, the sticky flag, the pair label and its sentence. Names may be columns made
    from ids, so that the window sorts no texts.

    Rows with ``found = false`` get NULL labels and sentence and never set the flag.
    """
    z = C.nan_to_null("zip")
    df = (looked_up
          .withColumn("bliss", C.nan_to_null("bliss"))
          .withColumn("loewe", C.nan_to_null("loewe"))
          .withColumn("hsa", C.nan_to_null("hsa"))
          .withColumn("zip", z)
          .withColumn("flag", F.col("found") & C.antagonism_flag("zip")))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("sticky", F.coalesce(F.bool_or("flag").over(w), F.lit(False)))
    label, word = C.pair_vote("bliss", "loewe", "hsa", "zip", "sticky")
    found = F.col("found")
    return (df
            .withColumn("bliss_label", F.when(found, C.classify_bliss("bliss")))
            .withColumn("loewe_label", F.when(found, C.classify_loewe("loewe")))
            .withColumn("hsa_label", F.when(found, C.classify_hsa("hsa")))
            .withColumn("zip_label", F.when(found, C.classify_zip("zip")))
            .withColumn("pair_label", F.when(found, label))
            .withColumn("sentence", F.when(found, C.pair_sentence(name_a, name_b, word))))


def verdict_aggregates(order=("i", "j")) -> list[Column]:
    """Aggregates over the scored pairs of one combination that ``verdict_columns`` reads."""
    found = F.col("found")
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("sentence").alias("s"))))
    return [F.bool_or(found & (F.col("zip") < C.ZIP_FLAG)).alias("_ant"),
            F.bool_or(found & (F.col("zip") > C.ZIP_HIGH)).alias("_syn"),
            F.count_if(found).alias("_found"),
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(~found).alias("missing_pairs"),
            F.count_if(F.col("pair_label") == C.SYNERGISTIC).alias("synergistic"),
            F.count_if(F.col("pair_label") == C.ADDITIVE).alias("additive"),
            F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("reasoning")]


def verdict_columns(key: str = "combo_id", on_missing: str = "skip") -> list[Column]:
    """prediction, reasoning and the counts, from the aggregates; see ``combo_verdict``."""
    if on_missing not in ("skip", "null", "error"):
        raise ValueError("on_missing must be 'skip', 'null' or 'error'")
    prediction = (F.when(F.col("_found") == 0, F.lit(None).cast("string"))
                  .when(F.col("_ant"), C.ANTAGONISTIC)
                  .when(F.col("_syn"), C.SYNERGISTIC)
                  .otherwise(C.ADDITIVE))
    reasoning = F.col("reasoning")
    short = F.col("missing_pairs") > 0
    if on_missing == "null":
        prediction = F.when(~short, prediction)
        reasoning = F.when(short, "").otherwise(reasoning)
    elif on_missing == "error":
        text = F.concat(F.lit("pairs without a score in combination "), F.col(key).cast("string"))
        prediction = F.when(short, F.raise_error(text).cast("string")).otherwise(prediction)
    return [prediction.alias("prediction"), reasoning.alias("reasoning"),
            *(F.col(c) for c in ("n_pairs", "missing_pairs", "synergistic", "additive"))]


def combo_verdict(scored: DataFrame, key: str = "combo_id", order=("i", "j"),
                  carry: tuple[str, ...] = (), on_missing: str = "skip", also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per combination. ``also``: more aggregates over its pairs, named columns behind ``carry``.

    ``on_missing``, for combinations with a pair that has no score: ``skip`` judges by the pairs
    found, ``null`` leaves the verdict NULL and the reasoning empty, ``error`` fails the job with
    the combination's key.

    prediction: any found pair with zip < -1 -> Antagonistic; else any zip > 15 ->
    Synergistic; else Additive; NULL when no pair was found. reasoning: pair sentences in
    pair order. synergistic / additive: pair-label counts. ``carry`` columns are
    functionally dependent on ``key`` and passed through; one pair with the value is enough.
    """
    agg = scored.groupBy(key).agg(*[F.any_value(c, F.lit(True)).alias(c) for c in carry], *also, *verdict_aggregates(order))
    own = agg.columns[1 + len(carry):][:len(also)]
    return agg.select(key, *carry, *own, *verdict_columns(key, on_missing))


def count_responses(scored: DataFrame, key: str = "combo_id") -> DataFrame:
    """Number of Synergistic and of Additive pair labels per combination."""
    return scored.groupBy(key).agg(
        F.count_if(F.col("pair_label") == C.SYNERGISTIC).alias("synergistic"),
        F.count_if(F.col("pair_label") == C.ADDITIVE).alias("additive"))
