"""Queries: evaluation metrics, ROUGE/BLEU, positional alignment and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from comboscore.functions import text as T
from comboscore.operators.evaluation import classification_report, metric_report, value_counts
from comboscore.operators.evaluator import Evaluator, evaluate, paired
from comboscore.operators.ordinal import (align, batches, contiguous_split, head, pad_length, random_split,
                                          slice_rows, tail, with_ordinal)
from comboscore.operators.textmetrics import bleu_row_counts, corpus_bleu, rouge
from comboscore.plans import lineage as L
from comboscore.plans import oracle as O
from comboscore.plans.registry import register
from comboscore.session import cut_lineage

EV = O.EVALS
SEED = L.SEED

# per-label support / predictions / hits over the (truth, pred) counts, then weighted sums
PRF_SQL = """, pc AS (SELECT truth, pred, count(*) AS c FROM ev GROUP BY truth, pred),
labs AS (SELECT truth AS label FROM pc UNION SELECT pred FROM pc),
pl2 AS (
  SELECT l.label,
    CAST(coalesce((SELECT sum(c) FROM pc WHERE pc.truth = l.label), 0) AS DOUBLE) AS support,
    CAST(coalesce((SELECT sum(c) FROM pc WHERE pc.pred = l.label), 0) AS DOUBLE) AS npred,
    CAST(coalesce((SELECT sum(c) FROM pc WHERE pc.truth = l.label AND pc.pred = l.label), 0) AS DOUBLE) AS tp
  FROM labs l),
w AS (
  SELECT sum(support) AS n,
    sum(CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END * support) AS wp,
    sum(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END * support) AS wr,
    sum(CASE WHEN support + npred > 0 THEN 2 * tp / (support + npred) ELSE 0.0 END * support) AS wf
  FROM pl2),
cc AS (
  SELECT count(*) FILTER (WHERE truth = pred) AS correct,
    count(*) FILTER (WHERE truth = pred AND truth <> 'no_pred') AS tp,
    count(*) FILTER (WHERE truth = pred AND truth = 'no_pred') AS tn,
    count(*) FILTER (WHERE truth <> pred AND pred <> 'no_pred') AS fp,
    count(*) FILTER (WHERE truth <> pred AND pred = 'no_pred') AS fn
  FROM ev),
rep AS (
  SELECT CAST(coalesce(w.n, 0) AS BIGINT) AS n,
    CASE WHEN w.n > 0 THEN cc.correct / w.n ELSE 0.0 END AS accuracy,
    CASE WHEN w.n > 0 THEN w.wp / w.n ELSE 0.0 END AS precision,
    CASE WHEN w.n > 0 THEN w.wr / w.n ELSE 0.0 END AS recall,
    CASE WHEN w.n > 0 THEN w.wf / w.n ELSE 0.0 END AS f1,
    cc.tp, cc.tn, cc.fp, cc.fn
  FROM w, cc)"""


def _report(spark, sf):
    return classification_report(L.eval_table(spark, sf))


@register("keyword_label", sql=O.with_ctes(*EV, select="SELECT combo_id, truth, pred FROM ev"))
def q_keyword_label(spark, sf):
    return L.eval_table(spark, sf)


@register("accuracy", sql=O.with_ctes(*EV, select=PRF_SQL + "\nSELECT n, accuracy FROM rep"))
def q_accuracy(spark, sf):
    return _report(spark, sf).select("n", "accuracy")


@register("confusion_counts", sql=O.with_ctes(*EV, select=PRF_SQL + "\nSELECT tp, tn, fp, fn FROM rep"))
def q_confusion_counts(spark, sf):
    return _report(spark, sf).select("tp", "tn", "fp", "fn")


@register("weighted_prf", sql=O.with_ctes(*EV, select=PRF_SQL + "\nSELECT precision, recall, f1 FROM rep"))
def q_weighted_prf(spark, sf):
    return _report(spark, sf).select("precision", "recall", "f1")


@register("metric_report", sql=O.with_ctes(*EV, select=PRF_SQL + """
SELECT 'accuracy' AS metric, accuracy AS value, 2 AS digits FROM rep
UNION ALL SELECT 'precision', precision, 2 FROM rep
UNION ALL SELECT 'recall', recall, 2 FROM rep
UNION ALL SELECT 'f1', f1, 2 FROM rep
UNION ALL SELECT 'tp', CAST(tp AS DOUBLE), 0 FROM rep
UNION ALL SELECT 'tn', CAST(tn AS DOUBLE), 0 FROM rep
UNION ALL SELECT 'fp', CAST(fp AS DOUBLE), 0 FROM rep
UNION ALL SELECT 'fn', CAST(fn AS DOUBLE), 0 FROM rep"""))
def q_metric_report(spark, sf):
    r = _report(spark, sf).select("accuracy", "precision", "recall", "f1", "tp", "tn", "fp", "fn")
    return metric_report(r, digits={"tp": 0, "tn": 0, "fp": 0, "fn": 0})


# --------------------------------------------------------------------- positional alignment

def _labels_and_answers(spark, sf):
    """Labels of all combinations and answers of those with three items or more, stored once."""
    rows = cut_lineage(L.Derived(spark, sf).answered.select("combo_id", "k", "prediction", "response"))
    return (rows.select("combo_id", "prediction"),
            rows.where(F.col("k") >= 3).select(F.col("combo_id").alias("rkey"), "response"))


@register("zip_min_length", sql=O.with_ctes(*EV, select="""
, fo AS (SELECT combo_id, prediction, row_number() OVER (ORDER BY combo_id) - 1 AS ordinal FROM fin),
ro AS (SELECT response, row_number() OVER (ORDER BY resp.combo_id) - 1 AS ordinal
  FROM resp JOIN combo_ids USING (combo_id) WHERE k >= 3)
SELECT fo.ordinal, fo.combo_id, fo.prediction, ro.response FROM fo JOIN ro ON ro.ordinal = fo.ordinal"""))
def q_zip_min_length(spark, sf):
    f, r = _labels_and_answers(spark, sf)
    return align(f, r, "combo_id", "rkey").select("ordinal", "combo_id", "prediction", "response")


@register("zip_prefix", sql=O.with_ctes(*EV, select="""
, fo AS (SELECT combo_id, prediction, row_number() OVER (ORDER BY combo_id) - 1 AS ordinal FROM fin),
ro AS (SELECT response, row_number() OVER (ORDER BY resp.combo_id) - 1 AS ordinal
  FROM resp JOIN combo_ids USING (combo_id) WHERE k >= 3)
SELECT fo.ordinal, fo.combo_id, fo.prediction, ro.response FROM fo JOIN ro ON ro.ordinal = fo.ordinal
WHERE fo.ordinal < 1001"""))
def q_zip_prefix(spark, sf):
    f, r = _labels_and_answers(spark, sf)
    return align(f, r, "combo_id", "rkey", n=1001).select("ordinal", "combo_id", "prediction", "response")


# --------------------------------------------------------------------- head / tail / slice / splits

@register("head_n", sql=O.with_ctes(*O.CORE, select="SELECT combo_id, prediction FROM vd ORDER BY combo_id LIMIT 1000"))
def q_head_n(spark, sf):
    return head(L.verdicts(spark, sf).select("combo_id", "prediction"), 1000, "combo_id")


@register("tail_n", sql=O.with_ctes(*O.CORE, select="""
SELECT combo_id, prediction FROM vd ORDER BY combo_id DESC LIMIT 8000"""))
def q_tail_n(spark, sf):
    return tail(L.verdicts(spark, sf).select("combo_id", "prediction"), 8000, "combo_id")


@register("slice_clamped", sql=O.with_ctes(*O.CORE, select="""
SELECT * FROM (SELECT combo_id, row_number() OVER (ORDER BY combo_id) - 1 AS ordinal FROM vd)
WHERE ordinal >= 12000 AND ordinal < 17000"""))
def q_slice_clamped(spark, sf):
    return slice_rows(L.verdicts(spark, sf).select("combo_id"), 12000, 5000, "combo_id")


@register("contiguous_split", sql=O.with_ctes(*O.CORE, select="""
, o AS (SELECT combo_id, row_number() OVER (ORDER BY combo_id) - 1 AS pos, count(*) OVER () AS n FROM vd)
SELECT combo_id, CASE WHEN pos < 1000 THEN 'test'
  WHEN pos < 1000 + CAST(floor(greatest(n - 1000, 0) * 0.9) AS BIGINT) THEN 'train' ELSE 'eval' END AS split
FROM o"""))
def q_contiguous_split(spark, sf):
    return contiguous_split(L.verdicts(spark, sf).select("combo_id"), "combo_id")


@register("random_split", sql=O.with_ctes(*O.CORE, select=f"""
, o AS (SELECT combo_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(combo_id AS VARCHAR)), combo_id) - 1
          AS pos, count(*) OVER () AS n FROM vd),
o2 AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS n_test FROM o)
SELECT combo_id, CASE WHEN pos < n - n_test THEN 'train'
  WHEN pos < n - n_test + (n_test - CAST(ceil(n_test / 2.0) AS BIGINT)) THEN 'valid' ELSE 'test' END AS split
FROM o2"""))
def q_random_split(spark, sf):
    return random_split(L.verdicts(spark, sf).select("combo_id"), "combo_id", SEED)


@register("shuffle_batches", sql=O.with_ctes(*O.CORE, select=f"""
SELECT combo_id, CAST(floor((row_number() OVER (ORDER BY md5('{SEED}:' || CAST(combo_id AS VARCHAR)), combo_id) - 1)
       / 8) AS BIGINT) AS batch_id FROM vd"""))
def q_shuffle_batches(spark, sf):
    return batches(L.verdicts(spark, sf).select("combo_id"), "combo_id", 8, seed=SEED)


@register("batch_pad_length", sql=O.with_ctes(*O.FULL, select=r"""
, b AS (SELECT combo_id, CAST(floor((row_number() OVER (ORDER BY combo_id) - 1) / 8) AS BIGINT) AS batch_id,
        CAST(len(list_filter(string_split_regex(prompt, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM fin)
SELECT combo_id, batch_id, max(n_tokens) OVER (PARTITION BY batch_id) AS pad_len FROM b"""))
def q_batch_pad_length(spark, sf):
    f = L.final(spark, sf).select("combo_id", F.size(T.ws_tokens("prompt")).alias("n_tokens"))
    # numbering reads its input twice
    return pad_length(batches(cut_lineage(f), "combo_id", 8), "n_tokens").select("combo_id", "batch_id", "pad_len")


@register("sort_desc_counts", sql=O.with_ctes(*O.FULL, select="""
SELECT row_number() OVER (ORDER BY count(*) DESC, prediction) - 1 AS position, prediction, count(*) AS count
FROM fin WHERE prediction IS NOT NULL GROUP BY prediction"""))
def q_sort_desc_counts(spark, sf):
    vc = value_counts(L.final(spark, sf), "prediction")
    return with_ordinal(vc, [F.col("count").desc(), F.col("prediction")], "position").select(
        "position", "prediction", "count")


# --------------------------------------------------------------------- ROUGE / BLEU over conversation turns

_ROUGE1 = r""", rt AS (
  SELECT conv_id, turn,
    list_filter(string_split(regexp_replace(lower(ref_text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS r,
    list_filter(string_split(regexp_replace(lower(cand_text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS c
  FROM turns),
rc AS (SELECT conv_id, turn, tok, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS tok FROM rt) GROUP BY ALL),
ccn AS (SELECT conv_id, turn, tok, count(*) AS n FROM (SELECT conv_id, turn, unnest(c) AS tok FROM rt) GROUP BY ALL),
hit AS (SELECT conv_id, turn, sum(least(rc.n, ccn.n)) AS h FROM rc JOIN ccn USING (conv_id, turn, tok) GROUP BY ALL),
r1 AS (
  SELECT rt.conv_id, rt.turn, CAST(coalesce(hit.h, 0) AS DOUBLE) AS h,
         CAST(len(rt.r) AS DOUBLE) AS nr, CAST(len(rt.c) AS DOUBLE) AS nc
  FROM rt LEFT JOIN hit ON hit.conv_id = rt.conv_id AND hit.turn = rt.turn),
r1p AS (SELECT conv_id, turn, CASE WHEN nc > 0 THEN h / nc ELSE 0.0 END AS p,
               CASE WHEN nr > 0 THEN h / nr ELSE 0.0 END AS r FROM r1),
r1f AS (SELECT conv_id, turn, p AS rouge1_p, r AS rouge1_r,
               CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS rouge1_f FROM r1p)"""
_RT = O.with_ctes(O.TURNS, select=_ROUGE1)


@register("rouge1", sql=_RT + "\nSELECT conv_id, turn, rouge1_p, rouge1_r, rouge1_f FROM r1f")
def q_rouge1(spark, sf):
    r = rouge(L.turns(spark, sf), "ref_text", "cand_text", kinds=("rouge1",))
    return r.select("conv_id", "turn", "rouge1_p", "rouge1_r", "rouge1_f")


@register("rouge_mean", sql=_RT + "\nSELECT avg(rouge1_f) AS rouge1_f FROM r1f")
def q_rouge_mean(spark, sf):
    r = rouge(L.turns(spark, sf), "ref_text", "cand_text", kinds=("rouge1",))
    return r.agg(F.avg("rouge1_f").alias("rouge1_f"))


# longest common subsequence, one reference token a step: ``best[j]`` is the length within the first
# j - 1 candidate tokens, and a step's new lengths are running maxima
_ROUGE_L = """, lt AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, r, c FROM rt),
lcs AS (
  SELECT k, 0 AS i, list_transform(range(len(c) + 1), lambda x: 0) AS best FROM lt
  UNION ALL
  SELECT k, i + 1, list(val ORDER BY j) FROM (
    SELECT k, i, j, max(val) OVER (PARTITION BY k ORDER BY j) AS val FROM (
      SELECT s.k, s.i, s.j,
             CASE WHEN s.j > 1 AND lt.c[s.j - 1] = lt.r[s.i + 1] THEN s.best[s.j - 1] + 1 ELSE s.best[s.j] END AS val
      FROM (SELECT lcs.k, lcs.i, lcs.best, unnest(range(1, len(lcs.best) + 1)) AS j
            FROM lcs JOIN lt USING (k) WHERE lcs.i < len(lt.r)) s JOIN lt ON lt.k = s.k))
  GROUP BY k, i),
ll AS (SELECT lt.conv_id, lt.turn, CAST(lcs.best[-1] AS DOUBLE) AS h, CAST(len(lt.r) AS DOUBLE) AS nr,
              CAST(len(lt.c) AS DOUBLE) AS nc FROM lt JOIN lcs ON lcs.k = lt.k AND lcs.i = len(lt.r)),
llp AS (SELECT conv_id, turn, CASE WHEN nc > 0 THEN h / nc ELSE 0.0 END AS p,
               CASE WHEN nr > 0 THEN h / nr ELSE 0.0 END AS r FROM ll),
llf AS (SELECT conv_id, turn, p AS rougeL_p, r AS rougeL_r,
               CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS rougeL_f FROM llp)"""
_RTL = (_RT + _ROUGE_L).replace("WITH ", "WITH RECURSIVE ", 1)


@register("rougeL", sql=_RTL + "\nSELECT conv_id, turn, rougeL_p, rougeL_r, rougeL_f FROM llf")
def q_rougeL(spark, sf):
    r = rouge(L.turns(spark, sf), "ref_text", "cand_text", kinds=("rougeL",))
    return r.select("conv_id", "turn", "rougeL_p", "rougeL_r", "rougeL_f")


@register("rouge_stemmed", note="Porter-stemmed ROUGE-1/L per turn (the reference's setting); no SQL twin")
def q_rouge_stemmed(spark, sf):
    return rouge(L.turns(spark, sf), "ref_text", "cand_text", stem=True).select(
        "conv_id", "turn", "rouge1_f", "rougeL_f")


@register("rouge_mean_stemmed", note="mean stemmed ROUGE-1 and ROUGE-L F over all turns")
def q_rouge_mean_stemmed(spark, sf):
    r = rouge(L.turns(spark, sf), "ref_text", "cand_text", stem=True)
    return r.agg(F.avg("rouge1_f").alias("rouge1_f"), F.avg("rougeL_f").alias("rougeL_f"))


@register("rougeL_mean", sql=_RTL + "\nSELECT avg(rougeL_f) AS rougeL_f FROM llf")
def q_rougeL_mean(spark, sf):
    r = rouge(L.turns(spark, sf), "ref_text", "cand_text", kinds=("rougeL",))
    return r.agg(F.avg("rougeL_f").alias("rougeL_f"))


def _bleu_ctes(*source: str) -> str:
    ws = r"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"
    grams = []
    for n in range(1, 5):
        g = f"list_transform(range(1, len(tok) - {n} + 2), lambda i: array_to_string(tok[i:i + {n} - 1], ' '))"
        grams.append(f"""g{n} AS (
  SELECT conv_id, turn, side, {n} AS n, unnest({g}) AS gram
  FROM tk)""")
    body = ",\n".join(grams)
    return O.with_ctes(*(source or (O.TURNS,)), select=f"""
, tk AS (
  SELECT conv_id, turn, 'r' AS side, {ws.format(t='ref_text')} AS tok FROM turns
  UNION ALL SELECT conv_id, turn, 'c', {ws.format(t='cand_text')} FROM turns),
{body},
gg AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4),
gc AS (SELECT conv_id, turn, side, n, gram, count(*) AS k FROM gg GROUP BY ALL),
clip AS (
  SELECT c.conv_id, c.turn, c.n, sum(least(c.k, coalesce(r.k, 0))) AS clipped, sum(c.k) AS total
  FROM gc c LEFT JOIN gc r ON r.side = 'r' AND r.conv_id = c.conv_id AND r.turn = c.turn AND r.n = c.n
                          AND r.gram = c.gram
  WHERE c.side = 'c' GROUP BY ALL),
ns AS (SELECT * FROM (VALUES (1), (2), (3), (4)) v(n)),
rows_n AS (
  SELECT t.conv_id, t.turn, ns.n, CAST(coalesce(clip.clipped, 0) AS BIGINT) AS clipped,
         CAST(greatest(1, coalesce(clip.total, 0)) AS BIGINT) AS total
  FROM turns t CROSS JOIN ns LEFT JOIN clip ON clip.conv_id = t.conv_id AND clip.turn = t.turn AND clip.n = ns.n),
lens AS (
  SELECT conv_id, turn, CAST(len({ws.format(t='cand_text')}) AS BIGINT) AS hyp_len,
         CAST(len({ws.format(t='ref_text')}) AS BIGINT) AS ref_len FROM turns),
per AS (
  SELECT l.conv_id, l.turn, l.hyp_len, l.ref_len,
    max(clipped) FILTER (WHERE n = 1) AS c1, max(clipped) FILTER (WHERE n = 2) AS c2,
    max(clipped) FILTER (WHERE n = 3) AS c3, max(clipped) FILTER (WHERE n = 4) AS c4,
    max(total) FILTER (WHERE n = 1) AS t1, max(total) FILTER (WHERE n = 2) AS t2,
    max(total) FILTER (WHERE n = 3) AS t3, max(total) FILTER (WHERE n = 4) AS t4
  FROM lens l JOIN rows_n r ON r.conv_id = l.conv_id AND r.turn = l.turn GROUP BY ALL)""")


@register("bleu_formula", sql=_bleu_ctes() + """
SELECT conv_id, turn, c1 AS clipped_1, c2 AS clipped_2, c3 AS clipped_3, c4 AS clipped_4,
       t1 AS total_1, t2 AS total_2, t3 AS total_3, t4 AS total_4, hyp_len, ref_len FROM per""")
def q_bleu_formula(spark, sf):
    rc = bleu_row_counts(L.turns(spark, sf), "ref_text", "cand_text")
    return rc.select("conv_id", "turn", *[F.col("clipped")[k].alias(f"clipped_{k + 1}") for k in range(4)],
                     *[F.col("total")[k].alias(f"total_{k + 1}") for k in range(4)], "hyp_len", "ref_len")


def _bleu_final_sql(*source: str) -> str:
    def p(k):
        return (f"CASE WHEN c{k} = 0 THEN 0.1 / CAST(t{k} AS DOUBLE) "
                f"ELSE CAST(c{k} AS DOUBLE) / CAST(t{k} AS DOUBLE) END")
    logp = " + ".join(f"ln({p(k)}) / 4" for k in range(1, 5))
    return _bleu_ctes(*source) + f"""
, tot AS (SELECT CAST(sum(c1) AS BIGINT) AS c1, CAST(sum(c2) AS BIGINT) AS c2, CAST(sum(c3) AS BIGINT) AS c3,
                 CAST(sum(c4) AS BIGINT) AS c4, CAST(sum(t1) AS BIGINT) AS t1, CAST(sum(t2) AS BIGINT) AS t2,
                 CAST(sum(t3) AS BIGINT) AS t3, CAST(sum(t4) AS BIGINT) AS t4,
                 CAST(sum(hyp_len) AS BIGINT) AS hyp_len, CAST(sum(ref_len) AS BIGINT) AS ref_len FROM per)
SELECT CASE WHEN coalesce(c1, 0) = 0 THEN 0.0
            ELSE (CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0
                       ELSE exp(1 - CAST(ref_len AS DOUBLE) / hyp_len) END) * exp({logp}) END AS bleu,
       c1 AS clipped_1, c2 AS clipped_2, c3 AS clipped_3, c4 AS clipped_4,
       t1 AS total_1, t2 AS total_2, t3 AS total_3, t4 AS total_4, hyp_len, ref_len
FROM tot"""


@register("corpus_bleu", sql=_bleu_final_sql())
def q_corpus_bleu(spark, sf):
    return corpus_bleu(L.turns(spark, sf), "ref_text", "cand_text")


# --------------------------------------------------------------------- whole evaluators over prompts and answers

FULL_ROWS = O.FULL + (O.RESPONSES,)
LABEL_EVALUATOR = Evaluator()
TEXT_EVALUATOR = Evaluator(truth="prompt", first_n=1001, strip_first=True, rouge_on="response")


def _answers(answered):
    """Answers of every combination but the pairs (a shorter table, so positions drift); every
    second one starts with a line of its own."""
    text = F.when(F.col("combo_id") % 2 == 0, F.concat(F.lit("Answer\n"), F.col("response"))).otherwise(F.col("response"))
    return answered.where(F.col("k") >= 3).select("combo_id", text.alias("response"))


def _evaluated(spark, sf, how, **options):
    # numbering reads its input twice on both sides: labels, prompts and answers are stored once
    rows = cut_lineage(L.Derived(spark, sf).answered.select("combo_id", "k", "prediction", "prompt", "response"))
    return evaluate(paired(rows, _answers(rows), "combo_id", "combo_id", "response", how), **options)


def _evaluator_sql(how: Evaluator) -> str:
    body = "CASE WHEN combo_id % 2 = 0 THEN 'Answer' || chr(10) || response ELSE response END"
    text = "substr(response, strpos(response, chr(10)) + 1)" if how.strip_first else "response"
    limit = f"WHERE fo.ordinal < {how.first_n}" if how.first_n is not None else ""
    rows = f"""ans AS (SELECT resp.combo_id, {body} AS response FROM resp JOIN combo_ids USING (combo_id) WHERE k >= 3),
fo AS (SELECT {how.truth} AS truth_text, {how.reference} AS reference, row_number() OVER (ORDER BY combo_id) - 1 AS ordinal
       FROM fin),
ro AS (SELECT {text} AS response, row_number() OVER (ORDER BY combo_id) - 1 AS ordinal FROM ans),
pe AS MATERIALIZED (SELECT fo.ordinal, fo.reference, ro.response, {O.kw("fo.truth_text")} AS truth, {O.kw("ro.response")} AS pred
       FROM fo JOIN ro ON ro.ordinal = fo.ordinal {limit})"""

    def turns(candidate):
        return f"turns AS (SELECT ordinal AS conv_id, 0 AS turn, reference AS ref_text, {candidate} AS cand_text FROM pe)"
    labels = O.with_ctes("ev AS (SELECT truth, pred FROM pe)", select=PRF_SQL + "\nSELECT * FROM rep")
    r1 = O.with_ctes(turns("pred" if how.rouge_on == "label" else "response"),
                     select=_ROUGE1 + "\nSELECT coalesce(avg(rouge1_f), 0.0) AS rouge1 FROM r1f")
    parts = [f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value, 2 AS digits FROM labels"
             for m in ("accuracy", "precision", "recall", "f1")]
    parts += [f"SELECT '{m}', CAST({m} AS DOUBLE), 0 FROM labels" for m in ("tp", "tn", "fp", "fn")]
    parts += ["SELECT 'rouge1', rouge1, 4 FROM r1", "SELECT 'bleu', bleu, 4 FROM bl"]
    one_row = [f"labels AS MATERIALIZED ({labels})", f"r1 AS MATERIALIZED ({r1})",
               f"bl AS MATERIALIZED ({_bleu_final_sql(turns('response'))})", f"rp AS ({' UNION ALL '.join(parts)})"]
    return O.with_ctes(*FULL_ROWS, rows, *one_row, select="""
SELECT metric, value, digits, CASE digits WHEN 0 THEN printf('%.0f', value) WHEN 2 THEN printf('%.2f', value)
       ELSE printf('%.4f', value) END AS text FROM rp""")


@register("evaluate_labels", sql=_evaluator_sql(LABEL_EVALUATOR),
          note="truth from the label column, ROUGE on the label word, BLEU on the whole answer")
def q_evaluate_labels(spark, sf):
    return _evaluated(spark, sf, LABEL_EVALUATOR, kinds=("rouge1",), stem=False)


@register("evaluate_texts", sql=_evaluator_sql(TEXT_EVALUATOR),
          note="truth from the prompt, first line of an answer dropped, first 1,001 positions")
def q_evaluate_texts(spark, sf):
    return _evaluated(spark, sf, TEXT_EVALUATOR, kinds=("rouge1",), stem=False)


@register("evaluate_labels_stemmed", note="the full report with stemmed ROUGE-1 and ROUGE-L; no SQL twin")
def q_evaluate_labels_stemmed(spark, sf):
    return _evaluated(spark, sf, LABEL_EVALUATOR)


# --------------------------------------------------------------------- streaming form of a row-local operator

@register("stream_keyword_label", sql=O.with_ctes(*EV, select=f"""
SELECT combo_id, {O.kw("response")} AS label FROM resp"""), note="file stream, availableNow trigger")
def q_stream_keyword_label(spark, sf):
    from comboscore.sources.files import landing_dir
    from comboscore.streaming.labels import label_stream, run_file_stream
    src = landing_dir(spark, "answers")
    answers = L.responses(spark, sf).drop("k")
    answers.write.parquet(src)
    out = run_file_stream(spark, src, answers.schema, lambda s: label_stream(s, "combo_id", "response"))
    return spark.read.parquet(out)
