"""Unordered-pair tables: dedupe by file order, enumerate a list's pairs, look pairs up.

Scale notes
-----------
* ``dedup_pairs`` is one hash aggregate on (lo, hi) with ``min_by``/``max_by``; Spark runs
  a map-side partial aggregate first, so a hot pair (any share of all rows) collapses to one
  row per map task before the shuffle.
* ``combo_pairs`` expands pairs inside each row (``inline`` of a higher-order array), so it
  adds no shuffle and keeps the input partitioning.
* ``lookup_pairs`` is an equi-join on the canonical (lo, hi) key — never an OR join. The
  planner broadcasts the deduplicated side if its stored size is below the byte threshold;
  otherwise it is a sort-merge join, and AQE splits skewed partitions of the probe side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.functions.pairs import index_pairs, pair_key

def dedup_pairs(scores: DataFrame, order: Sequence[str], keep: str = "first",
                a: str = "id_a", b: str = "id_b") -> DataFrame:
    """One row per unordered pair: the first (or last) row by ``order``.

    Returns ``id_lo, id_hi`` plus every column of ``scores``; the row keeps its own
    orientation (``a``/``b`` as stored).
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    lo, hi = pair_key(a, b)
    payload = F.struct(*[F.col(c) for c in scores.columns])
    ordk = F.struct(*[F.col(c) for c in order])
    pick = F.min_by(payload, ordk) if keep == "first" else F.max_by(payload, ordk)
    return (scores.groupBy(lo.alias("id_lo"), hi.alias("id_hi"))
            .agg(pick.alias("_r"))
            .select("id_lo", "id_hi", "_r.*"))


def combo_pairs(combos: DataFrame, key: str = "combo_id", ids: str = "ids",
                keep: Sequence[str] = ()) -> DataFrame:
    """All pairs (i < j, 0-based list positions) of every combination, one row each."""
    return (combos.select(key, *keep, F.inline(index_pairs(ids)))
            .withColumn("id_lo", F.least("a", "b"))
            .withColumn("id_hi", F.greatest("a", "b")))


def pair_table(scores: DataFrame, order: Sequence[str], columns: Sequence[str], a: str = "id_a",
               b: str = "id_b", keep: Sequence[str] = ("first", "last")) -> DataFrame:
    """One row per unordered pair: ``id_lo, id_hi`` and a struct of ``columns`` for each kept
    variant (``first`` / ``last`` by ``order``), all from a single aggregate."""
    lo, hi = pair_key(a, b)
    payload = F.struct(*[F.col(c) for c in columns])
    ordk = F.struct(*[F.col(c) for c in order])
    aggs = []
    if "first" in keep:
        aggs.append(F.min_by(payload, ordk).alias("first"))
    if "last" in keep:
        aggs.append(F.max_by(payload, ordk).alias("last"))
    return scores.groupBy(lo.alias("id_lo"), hi.alias("id_hi")).agg(*aggs)


def join_pairs(pairs: DataFrame, table: DataFrame, keep: str = "first", how: str = "left",
               columns: Sequence[str] | None = None) -> DataFrame:
    """Attach the ``keep`` row of ``table`` to every pair (equi-join on the canonical key)."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    right = table.select("id_lo", "id_hi", f"{keep}.*")
    if columns is not None:
        right = right.select("id_lo", "id_hi", *columns)
    out = pairs.join(right.withColumn("found", F.lit(True)), on=["id_lo", "id_hi"], how=how)
    return out.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def join_both(pairs: DataFrame, table: DataFrame, first: Sequence[str], last: Sequence[str],
              prefix: str = "last_") -> DataFrame:
    """Attach columns of the first row and (under ``prefix``) of the last row of every pair in one
    left join. A pair has both rows or none, so one ``found`` serves both."""
    right = table.select("id_lo", "id_hi", *(F.col("first")[c].alias(c) for c in first),
                         *(F.col("last")[c].alias(prefix + c) for c in last), F.lit(True).alias("found"))
    out = pairs.join(right, on=["id_lo", "id_hi"], how="left")
    return out.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def lookup_pairs(pairs: DataFrame, scores: DataFrame, order: Sequence[str], keep: str = "first",
                 how: str = "left", a: str = "id_a", b: str = "id_b",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Attach one score row to every pair, matching either orientation.

    ``keep="first"``/``how="left"`` is the scorer's lookup (missing pairs stay, ``found`` is
    false); ``keep="last"``/``how="inner"`` is the prompt builder's (missing pairs vanish).
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    cols = [c for c in (columns or scores.columns) if c not in ("id_lo", "id_hi")]
    table = pair_table(scores, order, cols, a=a, b=b, keep=(keep,))
    return join_pairs(pairs, table, keep=keep, how=how)
