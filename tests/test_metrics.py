"""ROUGE / BLEU / classification metrics against brute force and hand-computed values."""

import math
import random
from collections import Counter

import pytest

from comboscore.operators.evaluation import classification_report
from comboscore.operators.textmetrics import bleu_row_counts, corpus_bleu, lcs_length, rouge


def lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_lcs_matches_textbook_dp():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 25))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 25))]
        assert lcs_length(a, b) == lcs_brute(a, b)


def prf(hit, n_cand, n_ref):
    p = hit / n_cand if n_cand else 0.0
    r = hit / n_ref if n_ref else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_rouge_hand_example(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat on the mat"), (2, "", "a"), (3, None, "a"),
                                (4, "a", None)], "k int, ref string, cand string")
    got = {r.k: tuple(r)[3:] for r in rouge(df, "ref", "cand").collect()}
    assert got[1] == pytest.approx((1.0, 5 / 6, 10 / 11) * 2)
    assert got[2] == got[3] == got[4] == (0.0,) * 6
    with pytest.raises(ValueError):
        rouge(df, "ref", "cand", kinds=("rouge2",))


def test_rouge_and_bleu_counts_match_brute_force(spark):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30))),
              " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 30)))) for i in range(200)]
    df = spark.createDataFrame(texts, "k int, ref string, cand string")
    counts = bleu_row_counts(rouge(df, "ref", "cand"), "ref", "cand")
    assert "ArrowEvalPython" not in bleu_row_counts(rouge(df, "ref", "cand", kinds=("rouge1",)), "ref", "cand") \
        ._jdf.queryExecution().executedPlan().toString()
    for row in counts.collect():
        r, c = row.ref.split(), row.cand.split()
        hit = sum((Counter(r) & Counter(c)).values())
        assert (row.rouge1_p, row.rouge1_r, row.rouge1_f) == pytest.approx(prf(hit, len(c), len(r)))
        assert (row.rougeL_p, row.rougeL_r, row.rougeL_f) == pytest.approx(prf(lcs_brute(r, c), len(c), len(r)))
        grams = [[Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in (r, c)] for n in range(1, 5)]
        assert list(row.clipped) == [sum((a & b).values()) for a, b in grams]
        assert list(row.total) == [max(1, sum(b.values())) for _, b in grams]
        assert (row.hyp_len, row.ref_len) == (len(c), len(r))


def test_rouge_in_spark(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat.", "the cat, on THE mat"), (2, "", "x")],
                               "k int, ref string, cand string")
    got = {r.k: r for r in rouge(df, "ref", "cand").collect()}
    assert got[1].rouge1_f == pytest.approx(10 / 11) and got[1].rougeL_r == pytest.approx(5 / 6)
    assert got[2].rouge1_f == 0.0


def bleu_brute(pairs, max_n=4, eps=0.1):
    num, den = [0] * max_n, [0] * max_n
    hyp = ref = 0
    for r, c in pairs:
        for n in range(1, max_n + 1):
            cg = Counter(tuple(c[i:i + n]) for i in range(len(c) - n + 1))
            rg = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            num[n - 1] += sum(min(k, rg[g]) for g, k in cg.items())
            den[n - 1] += max(1, sum(cg.values()))
        hyp += len(c)
        ref += len(r)
    if num[0] == 0:
        return 0.0
    p = [(eps if a == 0 else a) / b for a, b in zip(num, den)]
    bp = 1.0 if hyp > ref else (0.0 if hyp == 0 else math.exp(1 - ref / hyp))
    return bp * math.exp(math.fsum(math.log(x) / max_n for x in p))


def test_corpus_bleu(spark):
    pairs = [("a b c", "a b d"), ("the quick brown fox jumps", "the quick brown dog"), ("x y", "z")]
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(pairs)], "k int, ref string, cand string")
    got = corpus_bleu(df, "ref", "cand").first().bleu
    assert got == pytest.approx(bleu_brute([(r.split(), c.split()) for r, c in pairs]), rel=1e-12)
    one = spark.createDataFrame([(0, "a b c", "a b d")], "k int, ref string, cand string")
    assert corpus_bleu(one, "ref", "cand").first().bleu == pytest.approx((2 / 3 * 1 / 2 * 0.1 * 0.1) ** 0.25)
    same = spark.createDataFrame([(0, "a b c d", "a b c d")], "k int, ref string, cand string")
    assert corpus_bleu(same, "ref", "cand").first().bleu == pytest.approx(1.0)


def prf_brute(truth, pred):
    labels = set(truth) | set(pred)
    n = len(truth)
    wp = wr = wf = 0.0
    for lab in labels:
        tp = sum(1 for t, p in zip(truth, pred) if t == p == lab)
        npred = sum(1 for p in pred if p == lab)
        sup = sum(1 for t in truth if t == lab)
        p = tp / npred if npred else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        wp, wr, wf = wp + p * sup, wr + r * sup, wf + f * sup
    return wp / n, wr / n, wf / n


def test_classification_report(spark):
    truth = ["a", "a", "b", "b", "c", "no_pred", "a"]
    pred = ["a", "b", "b", "b", "no_pred", "no_pred", "c"]
    df = spark.createDataFrame(list(zip(truth, pred)), "truth string, pred string")
    r = classification_report(df).first()
    p, rc, f = prf_brute(truth, pred)
    assert (r.precision, r.recall, r.f1) == (pytest.approx(p), pytest.approx(rc), pytest.approx(f))
    assert r.accuracy == pytest.approx(4 / 7)
    # tp: equal, truth != no_pred (3); tn: equal, truth == no_pred (1);
    # fp: unequal, pred != no_pred (2); fn: unequal, pred == no_pred (1)
    assert (r.tp, r.tn, r.fp, r.fn) == (3, 1, 2, 1)
    empty = spark.createDataFrame([], "truth string, pred string")
    e = classification_report(empty).first()
    assert (e.n, e.accuracy, e.f1, e.tp) == (0, 0.0, 0.0, 0)


def test_porter_stems():
    from comboscore.functions.stem import stem
    cases = {"caresses": "caress", "ponies": "poni", "ties": "tie", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "differentli": "differ", "vietnamization": "vietnam",
             "hopefulness": "hope", "sensibiliti": "sensibl", "electrical": "electr", "replacement": "replac",
             "adoption": "adopt", "controll": "control", "generously": "gener", "dying": "die", "says": "say",
             "cried": "cri", "synergistic": "synergist", "additive": "addit", "skies": "sky"}
    assert {w: stem(w) for w in cases} == cases


def test_stemmed_rouge(spark):
    df = spark.createDataFrame([(1, "the cats were running", "a cat runs")], "k int, ref string, cand string")
    r = rouge(df, "ref", "cand", stem=True).first()
    # stemmed: [the, cat, were, run] vs [a, cat, run] -> 2 hits
    assert r.rouge1_p == pytest.approx(2 / 3) and r.rouge1_r == pytest.approx(2 / 4)
    assert rouge(df, "ref", "cand").first().rouge1_p == pytest.approx(0.0)


def test_hits_of_batches_against_counting():
    import collections

    import numpy as np

    from comboscore.operators.textmetrics import lcs_length, row_hits
    rng = np.random.default_rng(0)

    def flat(lists):
        return np.concatenate([np.zeros(0, np.int64), *lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)

    for _ in range(100):
        n, kinds = int(rng.integers(0, 8)), int(rng.integers(1, 6))
        refs, cands = ([rng.integers(0, kinds + more, rng.integers(0, 12)) for _ in range(n)] for more in (0, 2))
        (r, rows_r), (c, rows_c) = flat(refs), flat(cands)
        overlap, lcs = row_hits(r, c, rows_r, rows_c, n)
        assert list(lcs) == [lcs_length(a.tolist(), b.tolist()) for a, b in zip(refs, cands)]
        assert list(overlap) == [sum((collections.Counter(a.tolist()) & collections.Counter(b.tolist())).values()) for a, b in zip(refs, cands)]


def test_ws_tokens_are_those_of_split(spark):
    from comboscore.functions.text import ws_tokens
    texts = ["", " ", "  a  b ", "a\tb\nc", "a\x1cb\x85c\xa0d", "é b", "a\u3000b c", "~ !", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ws_tokens("t")).collect()] == [None if t is None else t.split() for t in texts]
