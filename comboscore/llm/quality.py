"""Quality rules: robust multivariate outliers among documents of one language and source.

Statistics of every whole text are counted with numpy over Arrow batches. Each (language,
source) group then gets a minimum-covariance-determinant estimate of centre and scatter of the
transformed statistics: from three starts (medians and median deviations; the same scaled by the
covariance of spatial signs; and of tanh scores), concentration steps (keep the ``SHARE`` of rows
with the smallest Mahalanobis distance, estimate mean and covariance anew) go on until the
determinant falls no further, the smallest determinant of all wins, and one reweighting step
takes mean and covariance of the rows within ``NEAR`` of it. Just under half of a group's rows
may be anything, a pile of copies included. A document whose squared distance is over ``CUT``
is rejected.

Small groups lean on larger ones by one rule for every size: centre and scatter of a language are
drawn towards the whole table's, and those of a (language, source) towards its language's, each with
the weight n / (n + ``PRIOR``) for its own n rows that pass the base rule. So every row gets a
distance, and no verdict hangs on which side of a size a group lies. Centres and scatters are drawn
separately: the spread between a group and its language is not added to the scatter, where it would
excuse every row of a small odd group.

All steps are aggregates over all rows: the distance that bounds the nearest ``SHARE`` comes
from moments per logarithmic distance bin, so a group of any size is never collected, and the
estimates are joined back as a table with one row per group. ``FLOOR`` is added to the scatter,
so that statistics which hardly vary in a group don't make a small difference an outlier.

Defined results: a null text has no words (the base rule rejects it); null language or source
is a group of its own; the distance is null only if no row of the table passes the base rule;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.session import cut_lineage

SHARE, PRIOR = 0.5, 30
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
FLOOR = (0.6, 0.10, 0.15, 0.08, 0.08)            # least standard deviation of each feature
CUT = 30.0                                       # squared distance, five features
BINS = 16                                        # distance bins per factor of e
NEAR_SHARE, NEAR = 0.975, 12.8325                # reweighting: this quantile of chi-squared, five features
FALL = 1e-3                                      # least fall of the log determinant that is worth another step
KEY = ["level", "g_lang", "g_source"]            # 2: (language, source), 1: language, 0: whole table
COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _upto(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _repeats(document: np.ndarray, hashes: np.ndarray):
    """Flags: the (document, hash) pair occurs twice or more; and: it occurred before."""
    with np.errstate(over="ignore"):
        key = C.mix(hashes + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[by[1:]] = same
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    return twice, again


def text_counts(batches):
    for batch in batches:
        for sub, offsets, data in C.parts(batch):
            w = C.Words(offsets, data)
            document = w.documents()
            points = _upto((data & 0xC0) != 0x80)
            chars = _upto(points[w.ends] - points[w.starts])[w.bounds]
            symbols = _upto(_SYMBOL[data])[offsets]
            # lines: split at \n inside each document
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            first[1:] |= data == 10
            begin = np.flatnonzero(first[:-1])
            end = np.append(begin[1:], len(data))
            stop = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10) if len(data) else 0)
            has = np.searchsorted(w.starts, stop) > np.searchsorted(w.starts, begin)
            begin, stop = begin[has], stop[has]
            line_doc = np.searchsorted(offsets, begin, "right") - 1
            _, again = _repeats(line_doc, C.span_hashes(data, begin, stop))
            dup_lines = np.bincount(line_doc[again], minlength=sub.num_rows)
            repeat = np.zeros(len(w), bool)
            if len(w) > 2:
                at = np.flatnonzero(document[2:] == document[:-2])
                h = C.word_prefix(w.hashes)
                twice, _ = _repeats(document[at], C.word_span(h, at, at + 3))
                hit = at[twice]
                repeat = C.covered(hit, hit + 3, len(w))
            repeats = np.bincount(document[repeat], minlength=sub.num_rows)
            yield pa.record_batch([sub.column("doc_id"), sub.column("lang"), sub.column("source"),
                                   *(pa.array(x, pa.int64()) for x in (w.counts, np.diff(chars), np.diff(symbols), dup_lines, repeats))],
                                  names=[x.split()[0] for x in COUNTS.split(", ")])


def transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words").alias("f_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("f_length"),
            F.sqrt(F.col("n_symbols") / words).alias("f_symbols"),
            F.sqrt(F.col("n_dup_lines") / words * 10).alias("f_lines"),
            F.sqrt(F.col("n_repeat_words") / words).alias("f_repeats")]


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = ", ".join(["level int, g_lang string, g_source string, start int", *(f"m{i} double" for i in range(P)),
                      *(f"w{i}{j} double" for i, j in PAIRS), "logdet double, moving boolean"])


def _chi2(x: float, dof: int) -> float:
    """Distribution function of chi-squared, odd ``dof``."""
    out = math.erf(math.sqrt(x / 2))
    for k in range(1, dof, 2):
        out -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return out


def consistency(share: float) -> float:
    """What scales the scatter of the nearest ``share`` of a normal group up to the whole group's."""
    if share >= 1 - 1e-9:
        return 1.0
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, P) < share else (low, middle)
    return share / _chi2(high, P + 2)


def _matrix(row, name: str) -> np.ndarray:
    out = np.zeros((P, P))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = row[f"{name}{i}{j}"]
    return out


def _batch(rows):
    """Estimates (key, start, centre, scatter, log determinant, moving) as a batch with inverse scatters."""
    out = []
    for key, start, m, scatter, logdet, moving in rows:
        w = np.linalg.inv(scatter)
        out.append([*key, start, *m, *(w[i, j] * (2 if i != j else 1) for i, j in PAIRS), logdet, moving])
    cols = list(zip(*out)) if out else [[] for _ in range(6 + P + len(PAIRS))]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * (P + len(PAIRS) + 1), pa.bool_()]
    names = [*KEY, "start", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS), "logdet", "moving"]
    return pa.record_batch([pa.array(list(map(float, c)) if k == pa.float64() else c, k) for c, k in zip(cols, kinds)], names=names)


def _starts(batches):
    """Three first estimates of a group from its medians, scales and the moments of its scores."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m, d = [r[f"m{i}"] for i in range(P)], np.diag([r[f"d{i}"] for i in range(P)])
            key = [r[k] for k in KEY]
            for start, scores in enumerate((np.eye(P), P * _matrix(r, "u"), _matrix(r, "t"))):
                out.append((key, start, m, d @ (scores + 0.01 * np.eye(P)) @ d, math.inf, True))
        yield _batch(out)


def _estimate(share: float | None):
    """Estimates from the moments of the core about the former centre; ``share``: the core's, if fixed."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                shift = np.array([r[f"d{i}"] for i in range(P)]) / r["n"]
                s = _matrix(r, "s") / r["n"] - np.outer(shift, shift)
                # the kept rows are the core only: scale their scatter up to the whole of a normal group
                scatter = s * consistency(share or r["n"] / r["of"]) + np.diag(np.square(FLOOR))
                logdet = float(np.linalg.slogdet(scatter)[1])
                out.append(([r[k] for k in KEY], r["start"], np.array([r[f"m{i}"] for i in range(P)]) + shift, scatter,
                            logdet, logdet < r["before"] - FALL))
            yield _batch(out)
    return run


def _distance() -> Column:
    dev = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    terms = [F.col(f"w{i}{j}") * dev[i] * dev[j] for i, j in PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(1e-9))


def _moments() -> list[Column]:
    dev = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    return [F.count(F.lit(1)).alias("n"), F.max("logdet").alias("before"), *(F.max(f"m{i}").alias(f"m{i}") for i in range(P)),
            *(F.sum(x).alias(f"d{i}") for i, x in enumerate(dev)), *(F.sum(dev[i] * dev[j]).alias(f"s{i}{j}") for i, j in PAIRS)]


def _first(rows: DataFrame) -> DataFrame:
    middle = lambda x: F.percentile_approx(x, 0.5, 1000)
    medians = cut_lineage(rows.groupBy(*KEY).agg(*(middle(f).alias(f"m{i}") for i, f in enumerate(FEATURES))))
    scale = [F.sqrt(F.pow(1.4826 * middle(F.abs(F.col(f) - F.col(f"m{i}"))), 2) + FLOOR[i] ** 2).alias(f"d{i}")
             for i, f in enumerate(FEATURES)]
    scales = cut_lineage(rows.join(medians, KEY).groupBy(*KEY, *(f"m{i}" for i in range(P))).agg(*scale))
    z = rows.join(scales, KEY).select(*KEY, *(((F.col(f) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, f in enumerate(FEATURES)))
    square = F.greatest(reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(P))), F.lit(1e-12))
    signs = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / square).alias(f"u{i}{j}") for i, j in PAIRS]
    tanhs = [F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS]
    return scales.join(z.groupBy(*KEY).agg(*signs, *tanhs), KEY).mapInArrow(_starts, ESTIMATE)


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step of every estimate: the bins up to the one that holds the SHARE-th nearest row are the core."""
    one = [*KEY, "start"]
    bins = (rows.join(estimate, KEY).withColumn("bin", F.floor(F.log(_distance()) * BINS))
            .groupBy(*one, "bin").agg(*_moments()))
    by = Window.partitionBy(*one)
    core = (bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("of", F.sum("n").over(by))
            .where(F.col("upto") - F.col("n") < F.col("of") * SHARE))
    total = [F.sum(c).alias(c) for c in ["n", *(f"d{i}" for i in range(P)), *(f"s{i}{j}" for i, j in PAIRS)]]
    same = [F.max(c).alias(c) for c in ["of", "before", *(f"m{i}" for i in range(P))]]
    return core.groupBy(*one).agg(*total, *same).mapInArrow(_estimate(None), ESTIMATE)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Centre and inverse scatter of each key; ``rows`` hold the key and the features."""
    steps = [cut_lineage(_first(rows))]
    while not (moving := steps[-1].where("moving")).isEmpty():
        # each step lowers a determinant that FLOOR bounds from below, so this ends
        steps.append(cut_lineage(_concentrate(rows, moving)))
    best = Window.partitionBy(*KEY).orderBy("logdet", "start")
    raw = (reduce(DataFrame.unionByName, steps).withColumn("place", F.row_number().over(best))
           .where("place = 1").drop("place"))
    near = rows.join(cut_lineage(raw), KEY).where(_distance() <= NEAR)
    return cut_lineage(near.groupBy(*KEY, "start").agg(*_moments()).mapInArrow(_estimate(NEAR_SHARE), ESTIMATE))


JUDGE = ", ".join(["lang string", "source string", *(f"m{i} double" for i in range(P)), *(f"w{i}{j} double" for i, j in PAIRS)])


def _draw(whole):
    """Centre and inverse scatter that judge a group: its own, weighted n / (n + PRIOR), over its language's over the table's."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                centre = scatter = None
                for e in (whole, r["language"], r["own"]):
                    if e is None:                                    # no row of this key passes the base rule
                        continue
                    m = np.array([e[f"m{i}"] for i in range(P)])
                    w = _matrix(e, "w")
                    w[~np.eye(P, dtype=bool)] /= 2
                    s, own = np.linalg.inv(w), e["n"] / (e["n"] + PRIOR)
                    centre = m if centre is None else own * m + (1 - own) * centre
                    scatter = s if scatter is None else own * s + (1 - own) * scatter
                if centre is not None:
                    w = np.linalg.inv(scatter)
                    out.append([r["lang"], r["source"], *map(float, centre), *(float(w[i, j]) * (2 if i != j else 1) for i, j in PAIRS)])
            cols = list(zip(*out)) if out else [[] for _ in range(2 + P + len(PAIRS))]
            yield pa.record_batch([pa.array(c, pa.string() if i < 2 else pa.float64()) for i, c in enumerate(cols)],
                                  names=[x.split()[0] for x in JUDGE.split(", ")])
    return run


def _judges(groups: DataFrame, estimate: DataFrame) -> DataFrame:
    """(lang, source, centre, inverse scatter) for every group of ``groups``."""
    each = F.struct("n", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS))
    whole, language, own = (estimate.where(F.col("level") == k).select(
        F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), each.alias(name))
        for k, name in enumerate(("whole", "language", "own")))
    row = whole.first()                                              # the table's one estimate, or none
    out = groups.join(own, ["lang", "source"], "left").join(language.drop("source"), "lang", "left")
    return out.mapInArrow(_draw(row["whole"].asDict() if row else None), JUDGE)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", cut: float = CUT) -> DataFrame:
    """One row per document: the counts, base_failed, distance (squared), kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counts = cut_lineage(texts.mapInArrow(text_counts, COUNTS).withColumn("base_failed", base).select("*", *transformed()))
    # a row counts for its group, its language and the table
    levels = F.array(*(F.struct(F.lit(k).alias("level"), (F.col("lang") if k > 0 else F.lit("")).alias("g_lang"),
                                (F.col("source") if k > 1 else F.lit("")).alias("g_source")) for k in (2, 1, 0)))
    rows = counts.where("not base_failed").select(F.explode(levels).alias("key"), *FEATURES).select("key.*", *FEATURES)
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    estimate = cut_lineage(robust_estimates(rows).drop("start", "logdet", "moving").join(sizes, KEY))
    judges = cut_lineage(_judges(counts.select("lang", "source").distinct(), estimate))
    out = counts.join(judges, ["lang", "source"], "left").withColumn("distance", _distance())
    return out.withColumn("distance", F.when(F.col("w00").isNotNull(), F.col("distance"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)).alias("kept"))
