"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: words, the beginnings of longer words (``STEMS`` bytes;
inflected forms share them), neighbouring pairs and pairs with one word between, hashed to
2**``BITS`` buckets (ASCII letters lower-cased; punctuation is no part of a word). Training takes a bounded sample: at most ``SHARDS`` groups of about ``SAMPLE`` labelled
documents each, picked by a hash of the id (fewer groups where
there are fewer labels). Every group is one task that runs
FTRL-proximal with per-coordinate rates and L1, ``PASSES`` times over its documents; most
weights end at exactly 0. The groups' weights are averaged, and at most 2**``BITS`` of them
(in practice a few hundred) are broadcast. All documents are scored, over their whole texts.

Labels, language, source and id never enter a score. Defined results: a null or empty text
has no features and gets the bias alone; labels that are null are ignored, several labels of
one document count as toxic if one of them is; without labelled documents of both kinds the
score is the share of toxic ones (0 if there are none); other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import columnar as C

BITS = 20
SHARDS = 4
SAMPLE = 6000
PASSES = 3
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 0.4, 1.0, 2.0, 1.0


def features(words: C.Words):
    """(document, bucket) of every feature, repeats included."""
    h, d = words.hashes, words.documents()
    where, bucket = [d], [h]
    sums = C.prefix(words.data)
    for size in STEMS:
        long = np.flatnonzero(words.ends - words.starts > size)
        where.append(d[long])
        bucket.append(C.mix(C.between(sums, words.starts[long], words.starts[long] + size) ^ np.uint64(size)))
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x51ED270B27F3B4C5), (2, 0x8F3C2A6D1B47E905)):
            if len(h) > gap:
                same = np.flatnonzero(d[gap:] == d[:-gap])
                where.append(d[same])
                bucket.append(C.mix(h[same] * np.uint64(3) + h[same + gap] + np.uint64(salt)))
    return np.concatenate(where), (np.concatenate(bucket) >> np.uint64(64 - BITS)).astype(np.int64)


def _words(offsets, data):
    return C.Words(offsets, data, C.ALNUM_WORDS, lower=True)


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES):
    """FTRL-proximal over the documents in order; returns (bias, buckets, weights)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    prior = min(max(float(labels.mean()), 1e-6), 1 - 1e-6)
    z0 = n0 = 0.0
    start = math.log(prior / (1 - prior))

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def bias():                                   # how far the bias has moved from the prior
        return -z0 / ((BETA + math.sqrt(n0)) / ALPHA)

    for _ in range(passes):
        for at, y in zip(rows, labels):
            w = weights(z[at], n[at])
            b = bias()
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, start + b + float(w.sum())))))
            g = p - y
            if abs(g) < 1e-6:
                continue
            # per-coordinate rate: the more often a feature was seen in error, the smaller the step
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            s = (math.sqrt(n0 + g * g) - math.sqrt(n0)) / ALPHA
            z0 += g - s * b
            n0 += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return start + bias(), at, w[at]


def fit_shard(key, table):
    """Weights of one group of labelled documents; bucket -1 is the bias, -2 the rows seen."""
    t = table.sort_by([("doc_id", "ascending")])
    rows = []
    for batch in t.combine_chunks().to_batches():
        for sub, offsets, data in C.parts(batch):
            d, b = features(_words(offsets, data))
            pairs = np.unique((d << BITS) | b)
            at = np.searchsorted(pairs, np.arange(sub.num_rows + 1) << BITS)
            pairs = pairs & ((1 << BITS) - 1)
            rows += [pairs[i:j].astype(np.int32) for i, j in zip(at[:-1], at[1:])]
    labels = t.column("toxic").to_numpy().astype(float)
    order = np.argsort(C.mix(t.column("doc_id").to_numpy().astype(np.uint64)))
    if 0 < labels.mean() < 1:
        bias, at, w = fit([rows[i] for i in order], labels[order])
    else:
        bias, at, w = 0.0, np.zeros(0, np.int64), np.zeros(0)
    return pa.table([pa.array(np.concatenate([[-1, -2], at]), pa.int64()), pa.array(np.concatenate([[bias, labels.sum()], w]))],
                    names=["bucket", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, buckets, weights) from labelled documents outside the held-out fifth."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
             .where(~held_out("doc_id")))
    total = marks.count()
    if not total:
        return -math.inf, np.zeros(0, np.int64), np.zeros(0)
    want = min(total, sample * shards)
    shards = -(-want // sample)
    pick = F.xxhash64("doc_id", F.lit(17))
    marks = marks.where(F.pmod(pick, F.lit(total)) < want).withColumn("shard", F.pmod(F.shiftright(pick, 40), F.lit(shards)))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(marks, "doc_id").select("doc_id", "text", "toxic", "shard"))
    fits = rows.groupBy("shard").applyInArrow(fit_shard, "bucket long, weight double")
    means = (fits.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight"), F.count(F.lit(1)).alias("n"))
             .where("bucket < 0 or weight <> 0").collect())
    by = {r["bucket"]: r for r in means}
    if not by or not any(r["bucket"] >= 0 for r in means):
        toxic = marks.agg(F.avg("toxic")).first()[0] or 0.0
        return (math.log(toxic / (1 - toxic)) if 0 < toxic < 1 else math.inf if toxic else -math.inf,
                np.zeros(0, np.int64), np.zeros(0))
    got = sorted((r["bucket"], r["weight"]) for r in means if r["bucket"] >= 0)
    bias = by[-1]["weight"] * shards / by[-1]["n"]
    scale = shards / by[-1]["n"]
    return bias, np.array([b for b, _ in got]), np.array([w * scale for _, w in got])


def held_out(id_col: str):
    """The fifth of ids whose labels are never read: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_texts(model, text_col: str, score_col: str):
    def run(batches):
        bias, at, w = model.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            for sub, offsets, data in C.parts(batch, text_col):
                d, b = features(_words(offsets, data))
                hit = np.flatnonzero(dense[b])
                pairs = np.unique((d[hit] << BITS) | b[hit])
                total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], sub.num_rows) + bias
                with np.errstate(over="ignore"):
                    score = 1 / (1 + np.exp(-total))
                yield sub.set_column(sub.schema.get_field_index(score_col), score_col, pa.array(score))
    return run


def with_score(docs: DataFrame, labels: DataFrame, score_col: str, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """All columns of ``docs`` and the score, in a column of a new name."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, **options))
    out = docs.withColumn(score_col, F.lit(None).cast("double"))
    return out.mapInArrow(score_texts(model, text_col, score_col), out.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, score (0 to 1)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, labels, "score", **options).select("doc_id", "score")
