"""Queries: pair keys, lookups, dedupe, labels, vote, verdict (inventory 2.3-2.7, F1-F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from comboscore.functions import classify as C
from comboscore.functions.pairs import join_ids, pair_key, parse_ids
from comboscore.operators.ordinal import with_ordinal
from comboscore.operators.pairs import combo_pairs, dedup_pairs
from comboscore.operators.prompts import dedup_combo_key
from comboscore.operators.scoring import count_responses
from comboscore.plans import fixtures as fx
from comboscore.plans import lineage as L
from comboscore.plans import oracle as O
from comboscore.plans.registry import register

ORD = list(fx.ORDER_COLS)
ORD_SQL = ", ".join(ORD)
CORE = O.CORE


@register("combo_verdict", sql=O.with_ctes(*CORE, select="""
SELECT vd.combo_id, ci.drugs, vd.prediction, vd.reasoning, vd.n_pairs, vd.missing_pairs,
       vd.synergistic, vd.additive
FROM vd JOIN combo_ids ci ON ci.combo_id = vd.combo_id"""))
def q_combo_verdict(spark, sf):
    return L.verdicts(spark, sf)


@register("combo_verdict_sparse", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, *CORE[1:], select="""
SELECT vd.combo_id, ci.drugs, vd.prediction, vd.reasoning, vd.n_pairs, vd.missing_pairs,
       vd.synergistic, vd.additive
FROM vd JOIN combo_ids ci ON ci.combo_id = vd.combo_id"""), note="pairs missing from the score table")
def q_combo_verdict_sparse(spark, sf):
    from comboscore.operators.pairs import lookup_pairs
    from comboscore.operators.scoring import combo_verdict, score_pairs
    lk = lookup_pairs(L.pairs(spark, sf), fx.pair_scores(spark, sf, sparse=True), order=fx.ORDER_COLS,
                      keep="first", how="left", columns=L.SCORE_COLS)
    return combo_verdict(score_pairs(lk), carry=("drugs",))


@register("combo_verdict_growing", sql=O.with_ctes(*O.FULL_GROWING[:7], select="""
SELECT combo_id, prediction, reasoning, n_pairs, missing_pairs, synergistic, additive FROM vd"""),
          note="ids and pairs that grow with the data")
def q_combo_verdict_growing(spark, sf):
    return L.Derived(spark, sf, growing=True).verdicts.drop("drugs")


@register("combo_verdict_strict", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, *CORE[1:], select="""
SELECT vd.combo_id, CASE WHEN vd.missing_pairs = 0 THEN vd.prediction END AS prediction,
       CASE WHEN vd.missing_pairs = 0 THEN vd.reasoning ELSE '' END AS reasoning, vd.n_pairs, vd.missing_pairs
FROM vd"""), note="no verdict for a combination with a missing pair")
def q_combo_verdict_strict(spark, sf):
    from comboscore.operators.pairs import lookup_pairs
    from comboscore.operators.scoring import combo_verdict, score_pairs
    lk = lookup_pairs(L.pairs(spark, sf), fx.pair_scores(spark, sf, sparse=True), order=fx.ORDER_COLS,
                      keep="first", how="left", columns=L.SCORE_COLS)
    return combo_verdict(score_pairs(lk), on_missing="null").select("combo_id", "prediction", "reasoning", "n_pairs", "missing_pairs")


@register("pair_key", sql=O.with_ctes(O.PAIR_SCORES, select=f"""
SELECT {ORD_SQL}, least(id_a, id_b) AS id_lo, greatest(id_a, id_b) AS id_hi FROM ps"""))
def q_pair_key(spark, sf):
    lo, hi = pair_key("id_a", "id_b")
    return fx.pair_scores(spark, sf).select(*ORD, lo.alias("id_lo"), hi.alias("id_hi"))


def _dedup_sql(which: str) -> str:
    tbl = "fp" if which == "first" else "lp"
    ctes = (O.PAIR_SCORES, O.PAIR_NAMED, O.FIRST_PAIR if which == "first" else O.LAST_PAIR)
    return O.with_ctes(*ctes, select=f"""
SELECT lo AS id_lo, hi AS id_hi, id_a, id_b, bliss, loewe, hsa, zip, l_orderkey, l_linenumber FROM {tbl}""")


def _dedup(spark, sf, keep):
    d = dedup_pairs(fx.pair_scores(spark, sf), ORD, keep=keep)
    return d.select("id_lo", "id_hi", "id_a", "id_b", "bliss", "loewe", "hsa", "zip", "l_orderkey", "l_linenumber")


@register("dedup_first", sql=_dedup_sql("first"))
def q_dedup_first(spark, sf):
    return _dedup(spark, sf, "first")


@register("dedup_last", sql=_dedup_sql("last"))
def q_dedup_last(spark, sf):
    return _dedup(spark, sf, "last")


@register("pair_enumerate", sql=O.with_ctes(O.COMBOS, O.COMBO_PAIRS, select="SELECT combo_id, i, j, a, b FROM cp"))
def q_pair_enumerate(spark, sf):
    return combo_pairs(fx.combos(spark, sf)).select("combo_id", "i", "j", "a", "b")


@register("pair_lookup_first", sql=O.with_ctes(*CORE[:6], select="""
SELECT combo_id, i, j, found, name_a, name_b, bliss, loewe, hsa, zip FROM lk"""))
def q_pair_lookup_first(spark, sf):
    return L.first_lookup(spark, sf).select("combo_id", "i", "j", "found", *L.SCORE_COLS)


@register("pair_predicate", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, *CORE[1:5], select="""
SELECT cp.combo_id, cp.i, cp.j, fp.lo IS NOT NULL AS found, fp.id_a AS stored_a, fp.id_b AS stored_b
FROM cp LEFT JOIN fp ON fp.lo = cp.lo AND fp.hi = cp.hi"""), note="either orientation, sparse scores")
def q_pair_predicate(spark, sf):
    from comboscore.operators.pairs import lookup_pairs
    lk = lookup_pairs(L.pairs(spark, sf), fx.pair_scores(spark, sf, sparse=True), order=fx.ORDER_COLS,
                      columns=["id_a", "id_b"])
    return lk.select("combo_id", "i", "j", "found", F.col("id_a").alias("stored_a"), F.col("id_b").alias("stored_b"))


@register("pair_lookup_last", sql=O.with_ctes(*CORE[:5], O.LAST_PAIR, select="""
SELECT cp.combo_id, cp.i, cp.j, lp.name_a, lp.name_b, lp.loewe, lp.loewe_text
FROM cp JOIN lp ON lp.lo = cp.lo AND lp.hi = cp.hi"""))
def q_pair_lookup_last(spark, sf):
    return L.last_lookup(spark, sf, how="inner").select("combo_id", "i", "j", "name_a", "name_b", "loewe",
                                                         "loewe_text")


def _classify_sql(col: str, expr: str) -> str:
    return O.with_ctes(O.PAIR_SCORES, select=f"SELECT {ORD_SQL}, {expr} AS {col}_label FROM ps")


_CUT = "CASE WHEN {c} > 0.1 THEN '{hi}' WHEN {c} < -0.1 THEN '{lo}' ELSE 'Additive' END"


@register("classify_bliss", sql=_classify_sql("bliss", _CUT.format(c="bliss", hi="Synergistic", lo="Antagonistic")))
def q_classify_bliss(spark, sf):
    return fx.pair_scores(spark, sf).select(*ORD, C.classify_bliss("bliss").alias("bliss_label"))


@register("classify_loewe", sql=_classify_sql("loewe", _CUT.format(c="loewe", hi="Antagonistic", lo="Synergistic")))
def q_classify_loewe(spark, sf):
    return fx.pair_scores(spark, sf).select(*ORD, C.classify_loewe("loewe").alias("loewe_label"))


@register("classify_hsa", sql=_classify_sql("hsa", _CUT.format(c="hsa", hi="Synergistic", lo="Antagonistic")))
def q_classify_hsa(spark, sf):
    return fx.pair_scores(spark, sf).select(*ORD, C.classify_hsa("hsa").alias("hsa_label"))


@register("classify_zip", sql=_classify_sql("zip", """CASE WHEN zip > 15 THEN 'Highly Synergistic'
  WHEN zip < -15 THEN 'Highly Antagonistic' WHEN zip > 0 THEN 'Synergistic' WHEN zip < 0 THEN 'Antagonistic'
  ELSE 'Additive' END"""))
def q_classify_zip(spark, sf):
    return fx.pair_scores(spark, sf).select(*ORD, C.classify_zip("zip").alias("zip_label"))


@register("sticky_flag", sql=O.with_ctes(*CORE[:6], select="SELECT combo_id, i, j, sticky FROM sc"))
def q_sticky_flag(spark, sf):
    return L.scored(spark, sf).select("combo_id", "i", "j", "sticky")


@register("pair_vote", sql=O.with_ctes(*CORE[:6], select="SELECT combo_id, i, j, pair_label FROM sc"))
def q_pair_vote(spark, sf):
    return L.scored(spark, sf).select("combo_id", "i", "j", "pair_label")


@register("pair_sentence", sql=O.with_ctes(*CORE[:6], select="SELECT combo_id, i, j, sentence FROM sc WHERE found"))
def q_pair_sentence(spark, sf):
    return L.scored(spark, sf).where("found").select("combo_id", "i", "j", "sentence")


@register("count_responses", sql=O.with_ctes(*CORE, select="SELECT combo_id, synergistic, additive FROM vd"))
def q_count_responses(spark, sf):
    return count_responses(L.scored(spark, sf))


@register("reasoning_text", sql=O.with_ctes(*CORE, select="SELECT combo_id, reasoning FROM vd"))
def q_reasoning_text(spark, sf):
    return L.verdicts(spark, sf).select("combo_id", "reasoning")


@register("dedup_combo_key", sql=O.with_ctes(*CORE, select="""
SELECT ci.drugs, min(vd.combo_id) AS first_combo_id,
       arg_max(vd.prediction, vd.combo_id) AS prediction, arg_max(vd.reasoning, vd.combo_id) AS reasoning
FROM vd JOIN combo_ids ci ON ci.combo_id = vd.combo_id GROUP BY ci.drugs"""))
def q_dedup_combo_key(spark, sf):
    return dedup_combo_key(L.verdicts(spark, sf))


@register("join_list", sql=O.with_ctes(O.COMBOS, select="SELECT combo_id, drugs FROM combo_ids"))
def q_join_list(spark, sf):
    return L.combos(spark, sf).select("combo_id", "drugs")


@register("parse_combo", sql=O.with_ctes(O.COMBOS, select="""
SELECT combo_id, array_to_string(list_transform(string_split(drugs, ','), lambda x: CAST(trim(x) AS INTEGER)), '|')
         AS ids_text, CAST(len(string_split(drugs, ',')) AS INTEGER) AS n
FROM combo_ids"""))
def q_parse_combo(spark, sf):
    ids = parse_ids("drugs")
    return L.combos(spark, sf).select("combo_id", join_ids(ids, "|").alias("ids_text"), F.size(ids).alias("n"))


@register("row_ordinal", sql=O.with_ctes(O.PAIR_SCORES, select=f"SELECT ordinal - 1 AS ordinal, {ORD_SQL} FROM ps"))
def q_row_ordinal(spark, sf):
    return with_ordinal(fx.pair_scores(spark, sf).select(*ORD), ORD).select("ordinal", *ORD)
