"""ROUGE-1 / ROUGE-L per row and corpus BLEU.

ROUGE-1: clipped overlap is the size of a multiset intersection. Each row's tokens are sorted
and numbered within runs of equal ones, which makes them distinct, so the overlap is the
size of a plain ``array_intersect``. BLEU needs four n-gram lengths of the same tokens: the
n-grams of both sides become integers in a sorted array, and a fold counts them (row-local,
no shuffle, no Python). The longest common subsequence has no built-in and runs bit-parallel in an Arrow function, only when ``rougeL`` is asked
for; with stemming one function returns both kinds of hits, so stems do not go back. The
corpus-level numbers are plain Spark sums (map-side partial aggregation, one row out).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comboscore.functions.text import rouge_tokens, ws_tokens

ROUGE_KINDS = ("rouge1", "rougeL")
BLEU_MAX_N = 4


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token lists, bit-parallel.

    Bit j of ``row`` is zero where the best length grows at token j of ``b``; one token of ``a`` is one
    addition of long integers, so memory is linear and a step handles 64 tokens of ``b`` a word. The
    shorter list is ``b``; a token that it lacks changes nothing.
    """
    if len(b) > len(a):
        a, b = b, a
    where: dict = {}
    for j, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        hit = row & where.get(t, 0)
        if not hit:
            continue
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _starts(lists: pa.Array) -> np.ndarray:
    """Where the rows of a list array begin (and end) in its flattened values."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)


# Tokens stay in Arrow's buffers: only a batch's distinct tokens, or one row's numbers, become Python objects.

@F.arrow_udf(T.LongType())
def _lcs_udf(ref: pa.Array, cand: pa.Array) -> pa.Array:
    values = pa.concat_arrays([ref.flatten(), cand.flatten()])
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    r, c = _starts(ref), _starts(cand) + len(ref.flatten())
    return pa.array([lcs_length(codes[r[i]:r[i + 1]].tolist(), codes[c[i]:c[i + 1]].tolist()) for i in range(len(ref))], pa.int64())


def row_hits(ref: np.ndarray, cand: np.ndarray, rows_ref: np.ndarray, rows_cand: np.ndarray, count: int):
    """(clipped overlap, longest common subsequence) of ``count`` pairs of token lists, given as codes and their rows.

    Only tokens that both lists of a row hold matter: the others go, and a row's lists are walked
    in Python only if both keep two tokens or more.
    """
    base = int(max(ref.max(initial=0), cand.max(initial=0))) + 1
    known = np.zeros((2, base), bool)
    known[0, ref], known[1, cand] = True, True
    both = known.all(0)
    r, c = (rows[both[codes]] * base + codes[both[codes]] for rows, codes in ((rows_ref, ref), (rows_cand, cand)))
    kinds, place, n_cand = np.unique(c, return_inverse=True, return_counts=True)
    if not len(kinds):
        return np.zeros(count, np.int64), np.zeros(count, np.int64)
    at = np.minimum(np.searchsorted(kinds, r), len(kinds) - 1)
    shared = kinds[at] == r
    n_ref = np.bincount(at[shared], minlength=len(kinds))
    overlap = np.bincount(kinds // base, np.minimum(n_ref, n_cand), count).astype(np.int64)
    r, c = r[shared], c[n_ref[place] > 0]
    ends_r, ends_c = (np.searchsorted(x // base, np.arange(count + 1)) for x in (r, c))
    lcs = np.minimum(np.diff(ends_r), np.diff(ends_c))           # right where one list keeps one token or none
    for i in np.flatnonzero(lcs > 1).tolist():
        lcs[i] = lcs_length(r[ends_r[i]:ends_r[i + 1]].tolist(), c[ends_c[i]:ends_c[i + 1]].tolist())
    return overlap, lcs.astype(np.int64)


def _rows_of(lists: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(_starts(lists)))


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in ROUGE_KINDS]))
def _stemmed_hits_udf(ref: pa.Array, cand: pa.Array) -> pa.Array:
    """Hits of each kind after Porter-stemming tokens longer than three characters (shorter ones are kept). Stems
    stay here: two numbers a row go back."""
    from comboscore.functions.stem import stem
    tokens = pa.concat_arrays([ref.flatten(), cand.flatten()]).dictionary_encode()
    stems = pa.array([stem(t) if len(t) > 3 else t for t in tokens.dictionary.to_pylist()], pa.string()).dictionary_encode()
    codes = stems.indices.to_numpy(zero_copy_only=False)[tokens.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
    rows = [_rows_of(x) for x in (ref, cand)]
    hits = row_hits(codes[:len(rows[0])], codes[len(rows[0]):], *rows, len(ref))
    return pa.StructArray.from_arrays([pa.array(h, pa.int64()) for h in hits], names=list(ROUGE_KINDS))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda variable, not a repeated expression)."""
    return F.transform(F.array(value), body)[0]


def numbered(tokens: Column) -> Column:
    """Every token with its occurrence number in front: equal tokens become distinct."""
    def runs(s, starts):
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(s)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.transform(
            F.sequence(F.lit(0), b - a - 1), lambda k: F.concat(k.cast("string"), F.lit(" "), F.get(s, a)))))

    def of_sorted(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return _bind(starts, lambda at: runs(s, at))
    return F.when(F.size(tokens) > 0, _bind(F.array_sort(tokens), of_sorted)).otherwise(_no_tokens())


def overlap(ref: Column, cand: Column) -> Column:
    """Clipped overlap of two token arrays: sum over tokens of the smaller count."""
    return _of_shared(ref, cand, lambda: F.size(F.array_intersect(numbered(ref), numbered(cand))).cast("long"))


FEW = 8         # distinct values in both arrays that are counted one by one


def _of_shared(ref: Column, cand: Column, many) -> Column:
    """Clipped overlap: ``FEW`` shared values at most are counted in both arrays, ``many`` of them otherwise."""
    def count(values, x):
        return F.size(F.filter(values, lambda y: y == x))

    def of(shared):
        few = F.aggregate(shared, F.lit(0).cast("long"), lambda n, x: n + F.least(count(ref, x), count(cand, x)))
        return F.when(F.size(shared) <= FEW, few).otherwise(many())
    return _bind(F.array_intersect(ref, cand), of)


def _matched(ref: Column, cand: Column) -> Column:
    """Sum over values of the smaller of the two counts, for two arrays of even integers."""
    return _of_shared(ref, cand, lambda: _folded(ref, cand))


def _folded(ref: Column, cand: Column) -> Column:
    """``_matched`` of any number of shared values.

    Both sides lie in one sorted array, the candidate's values plus one, so each value's
    references come just before its candidates. The fold holds the references not matched yet.
    """
    both = F.array_sort(F.concat(ref, F.transform(cand, lambda x: x + 1)))
    zero = F.lit(0).cast("long")

    def step(acc, x):
        value = x.bitwiseAND(-2)
        free = F.when(acc["value"] == value, acc["free"]).otherwise(zero)
        hit = (x != value) & (free > 0)
        return F.struct(value.alias("value"), F.when(x == value, free + 1).when(hit, free - 1).otherwise(free).alias("free"),
                        F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))
    # an odd value is no gram
    start = F.struct(F.lit(1).cast("long").alias("value"), zero.alias("free"), zero.alias("n"))
    return F.aggregate(both, start, step, lambda acc: acc["n"])


def clipped_counts(ref: Column, cand: Column, max_n: int) -> Column:
    """Array with, per n-gram length 1..``max_n``, the sum over n-grams of the smaller of the two counts.

    Tokens become 64-bit hashes once; a longer gram's hash is made of the gram without its
    last token and that token. Row-local, n log n, no strings beyond the first step. Where no gram
    of a length is shared, no longer one is, and none is made.
    """
    def even(tokens):
        return F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(-2))

    def longer(grams, words, n):
        return F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - 1, F.lit(0))),
                           lambda g, i: F.xxhash64(g, F.get(words, i + (n - 1))).bitwiseAND(-2))

    def of(x, n):
        if n == max_n:
            return F.array(_matched(x["r"], x["c"]))
        more = F.struct(longer(x["r"], x["rw"], n + 1).alias("r"), longer(x["c"], x["cw"], n + 1).alias("c"), x["rw"].alias("rw"), x["cw"].alias("cw"))
        none = F.array(*[F.lit(0).cast("long")] * (max_n - n))
        return _bind(_matched(x["r"], x["c"]), lambda k: F.concat(
            F.array(k), F.when(k == 0, none).otherwise(_bind(more, lambda y: of(y, n + 1)))))
    words = F.struct(even(ref).alias("r"), even(cand).alias("c"))
    return _bind(words, lambda w: _bind(F.struct(w["r"].alias("r"), w["c"].alias("c"), w["r"].alias("rw"), w["c"].alias("cw")), lambda x: of(x, 1)))


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def _with_tokens(df: DataFrame, reference: str, candidate: str, tokenizer) -> DataFrame:
    return df.withColumns({"_ref": F.coalesce(tokenizer(F.col(reference)), _no_tokens()),
                           "_cand": F.coalesce(tokenizer(F.col(candidate)), _no_tokens())})


def _prf(name: str, hit: Column) -> list[Column]:
    def share(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(hit, F.size("_cand")), share(hit, F.size("_ref"))
    return [p.alias(name + "_p"), r.alias(name + "_r"), share(2 * p * r, p + r).alias(name + "_f")]


def rouge(df: DataFrame, reference: str, candidate: str, tokenizer=rouge_tokens, stem: bool = False,
          kinds: Sequence[str] = ROUGE_KINDS) -> DataFrame:
    """Adds ``<kind>_p``, ``_r`` and ``_f`` per kind (reference = target, candidate = prediction).

    A NULL text counts as empty. ``stem=True`` Porter-stems tokens longer than three
    characters on both sides first.
    """
    if unknown := set(kinds) - set(ROUGE_KINDS):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    t = _with_tokens(df, reference, candidate, tokenizer)
    if stem:
        t = t.withColumn("_hits", _stemmed_hits_udf("_ref", "_cand"))
        return t.select(*df.columns, *[c for k in kinds for c in _prf(k, F.col("_hits")[k])])
    hits = {"rouge1": lambda: overlap(F.col("_ref"), F.col("_cand")), "rougeL": lambda: _lcs_udf("_ref", "_cand")}
    t = t.withColumns({"_hit_" + k: hits[k]() for k in kinds})
    return t.select(*df.columns, *[c for k in kinds for c in _prf(k, F.col("_hit_" + k))])


def bleu_row_counts(df: DataFrame, reference: str, candidate: str, tokenizer=ws_tokens,
                    max_n: int = BLEU_MAX_N) -> DataFrame:
    """Adds ``clipped`` and ``total`` (arrays, one entry per n-gram length), ``hyp_len``, ``ref_len``."""
    t = _with_tokens(df, reference, candidate, tokenizer)
    n_cand = F.size("_cand")
    total = [F.greatest(F.lit(1), n_cand - n + 1).cast("long") for n in range(1, max_n + 1)]
    return t.select(*df.columns, clipped_counts(F.col("_ref"), F.col("_cand"), max_n).alias("clipped"), F.array(*total).alias("total"),
                    n_cand.cast("long").alias("hyp_len"), F.size("_ref").cast("long").alias("ref_len"))


def corpus_bleu(df: DataFrame, reference: str, candidate: str, max_n: int = BLEU_MAX_N,
                eps: float = 0.1, tokenizer=ws_tokens) -> DataFrame:
    """One row: corpus BLEU with uniform weights, one reference per row, method-1 smoothing
    (a zero n-gram numerator becomes ``eps``), 0 when no unigram matches.

    Per n the corpus precision is sum(clipped) / sum(max(1, candidate n-grams)); brevity
    penalty 1 if hyp_len > ref_len else exp(1 - ref_len / hyp_len) (0 when hyp_len = 0).
    """
    rc = bleu_row_counts(df, reference, candidate, tokenizer, max_n)
    sums = rc.agg(*[F.sum(F.col("clipped")[k]).alias(f"c{k + 1}") for k in range(max_n)],
                  *[F.sum(F.col("total")[k]).alias(f"t{k + 1}") for k in range(max_n)],
                  F.sum("hyp_len").alias("hyp_len"), F.sum("ref_len").alias("ref_len"))
    logp = None
    for k in range(1, max_n + 1):
        c, t = F.col(f"c{k}"), F.col(f"t{k}")
        p = F.when(c == 0, F.lit(eps) / t).otherwise(c / t)
        term = F.log(p) / max_n
        logp = term if logp is None else logp + term
    hyp, ref = F.col("hyp_len"), F.col("ref_len")
    bp = F.when(hyp > ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1 - ref / hyp))
    bleu = F.when(F.coalesce(F.col("c1"), F.lit(0)) == 0, F.lit(0.0)).otherwise(bp * F.exp(logp))
    return sums.select(bleu.alias("bleu"), *[F.col(f"c{k}").alias(f"clipped_{k}") for k in range(1, max_n + 1)],
                       *[F.col(f"t{k}").alias(f"total_{k}") for k in range(1, max_n + 1)],
                       "hyp_len", "ref_len")
