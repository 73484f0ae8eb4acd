"""Prompt and context rendering, dataset assembly and typo injection.

``render_prompts`` aggregates the looked-up pairs of each combination (at most ten) in pair
order. ``labelled_prompts`` builds labels and prompts together: one pair lookup, one shuffle on
the key and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comboscore.functions import text as T
from comboscore.operators.scoring import score_pairs, verdict_aggregates, verdict_columns


def prompt_aggregates(order=("i", "j"), score_text: str | Column = "loewe_text", prefix: str = "",
                      names=("name_a", "name_b")) -> list[Column]:
    """Aggregates over the looked-up pairs of one combination that ``prompt_columns`` reads;
    ``prefix`` stands before the looked-up columns. Names and score texts may be columns (made from ids
    and numbers, so that shuffles carry no texts)."""
    found = F.col("found")
    a, b, text = (F.col(prefix + c) if isinstance(c, str) else c for c in (*names, score_text))
    sent = F.when(found, T.score_sentence(a, b, text))
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], sent.alias("s"))))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(found, F.array(a, b))))))
    return [F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("_ctx"),
            F.array_join(names, ", ").alias("names")]


def prompt_columns(rule: str = T.LOEWE_RULE) -> list[Column]:
    """prompt, context and names, from the aggregates; see ``render_prompts``."""
    context = F.concat(F.lit(T.CONTEXT_PREFIX), F.col("_ctx"))
    return [T.render_prompt(context, F.col("names"), rule).alias("prompt"), context.alias("context"), F.col("names")]


def render_prompts(looked_up: DataFrame, key: str = "combo_id", order=("i", "j"),
                   score_text: str | Column = "loewe_text", rule: str = T.LOEWE_RULE,
                   names=("name_a", "name_b")) -> DataFrame:
    """(key, prompt, context, names) from pairs looked up with ``found`` flags.

    context: ``"Context: "`` + score sentences of found pairs in pair order, joined by a
    blank. names: distinct names over both sides of the found pairs, sorted, joined by
    ``", "``. A combination without found pairs keeps an empty context and name list.
    """
    agg = looked_up.groupBy(key).agg(*prompt_aggregates(order, score_text, names=names))
    return agg.select(key, *prompt_columns(rule))


def labelled_prompts(looked_up: DataFrame, key: str = "combo_id", order=("i", "j"), carry: tuple[str, ...] = (),
                     score_text: str | Column = "loewe_text", rule: str = T.LOEWE_RULE, prefix: str = "last_",
                     on_missing: str = "skip", names=("name_a", "name_b"), last_names=("name_a", "name_b"),
                     also: tuple[Column, ...] = ()) -> DataFrame:
    """Verdict and prompt of every combination from pairs that carry both rows (``join_both``): the
    window of the sticky flag and one aggregate, on one partitioning by ``key``.

    (key, carry, prediction, reasoning, n_pairs, missing_pairs, synergistic, additive, prompt,
    context, names), as ``combo_verdict`` and ``render_prompts`` give them; ``also``: more aggregates,
    named columns behind ``carry``. Names that are columns are made after the window.
    """
    agg = score_pairs(looked_up, key, order, *names).groupBy(key).agg(
        *[F.any_value(c, F.lit(True)).alias(c) for c in carry], *also, *verdict_aggregates(order),
        *prompt_aggregates(order, score_text, prefix, last_names))
    own = agg.columns[1 + len(carry):][:len(also)]
    return agg.select(key, *carry, *own, *verdict_columns(key, on_missing), *prompt_columns(rule))


def dedup_combo_key(labelled: DataFrame, combo_key: str = "drugs", position: str = "combo_id",
                    values=("prediction", "reasoning")) -> DataFrame:
    """Collapse equal ordered combinations: position of the first occurrence, values of the
    last (a dict keyed by the id tuple)."""
    last = F.max_by(F.struct(*[F.col(v) for v in values]), F.col(position))
    return (labelled.groupBy(combo_key)
            .agg(F.min(position).alias("first_" + position), last.alias("_v"))
            .select(combo_key, "first_" + position, *[F.col("_v")[v].alias(v) for v in values]))


def perturb(df: DataFrame, col: str, key: str, seed: int, marker: str = T.NAMES_MARKER) -> DataFrame:
    """Replace ``col`` by its corrupted form; the typo rule per row is picked by md5 parity
    of ``seed:key`` (swap middle letters on even, drop the last letter on odd)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    use_swap = F.instr(F.lit("02468ace"), F.substring(h, 32, 1)) > 0
    return df.withColumn(col, T.perturb_names(F.col(col), use_swap, marker))


def with_suffix(path: str, suffix: str = "_messy", ext: str = ".csv") -> str:
    """``name.csv`` -> ``name_messy.csv`` (every occurrence, like ``str.replace``)."""
    return path.replace(ext, suffix + ext)
