"""Vector tables: group-wise mean, silhouette per sample and per label, 2-D projection.

Silhouette has two modes.

* ``sqeuclidean`` (linear): for each label c keep N_c, the vector sum S_c and Q_c = sum of
  squared norms; then sum_{y in c} |x - y|^2 = N_c |x|^2 + Q_c - 2 x.S_c. The per-label rows
  are a table, dealt into blocks of about ``block_labels`` labels; every point meets every block by
  an equi-join on (block, salt), so points travel once per block, not once per label, and no
  statistic passes through the driver.
* ``euclidean`` (exact, the metric of the published measure): no closed form exists, the work is
  n^2 * d. Points are hashed into B blocks; block pair (p, q) receives block p as "left"
  and block q as "right" (each point is sent to 2B tasks — an equi-join on a generated
  block key, never a cartesian product), and numpy computes per-label distance sums for
  each left point. Partial sums are then added up per (point, label). Memory per task is
  two blocks of about ``block_rows`` points. No registered query uses it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comboscore.session import cut_lineage

SALTS = 64   # copies of each block of label statistics; spreads the points that meet it over the tasks


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean vector per key (``array<double>``); map-side partial sums."""
    el = df.select(key, F.posexplode(vec).alias("_k", "_v"))
    per = el.groupBy(key, "_k").agg(F.avg("_v").alias("_m"))
    return (per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", "_m"))).alias("_s"))
            .select(key, F.transform("_s", lambda x: x["_m"]).alias(vec)))


def _label_stats(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(c, n, q, s): one row per label, its rows, sum of squared norms and vector sum."""
    el = df.select(F.col(label).alias("c"), F.posexplode(vec).alias("_k", "_v")).withColumn("_v", F.col("_v").cast("double"))
    sums = el.groupBy("c", "_k").agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"),
                                     F.count(F.lit(1)).alias("_n"))
    per = sums.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_S"),
                                F.sum("_q").alias("q"), F.max("_n").alias("n"))
    return per.select("c", "n", "q", F.transform("_S", lambda x: x["_s"]).alias("s"))


def _linear_silhouette(df: DataFrame, id_col: str, vec: str, label: str, block_labels: int) -> DataFrame:
    """Squared-Euclidean silhouette from the per-label table (see the module text)."""
    stats = cut_lineage(_label_stats(df, vec, label))
    n_blocks = max(1, math.ceil(stats.count() / block_labels))
    blocks = (stats.groupBy(F.pmod(F.xxhash64("c"), F.lit(n_blocks)).alias("_block"))
              .agg(F.collect_list(F.struct("c", "n", "q", "s")).alias("_stats"))
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    points = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_own"), x.alias("_x"),
                       F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v).alias("_xx"),
                       F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("_salt"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("_block"))

    def to_label(st):
        dot = F.aggregate(F.zip_with(F.col("_x"), st["s"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        d = F.greatest(st["n"] * F.col("_xx") + st["q"] - 2 * dot, F.lit(0.0))
        return F.struct(st["c"].alias("c"), st["n"].alias("n"), d.alias("d"))
    met = (points.join(blocks, ["_block", "_salt"])
           .select("_id", "_own", F.transform("_stats", to_label).alias("_d")))
    own = F.get(F.filter("_d", lambda t: t["c"] == F.col("_own")), 0)
    other = F.filter("_d", lambda t: t["c"] != F.col("_own"))
    per = met.select("_id", "_own", own.alias("_o"), F.array_min(F.transform(other, lambda t: t["d"] / t["n"])).alias("_b"))
    one = per.groupBy("_id", "_own").agg(F.max("_o.n").alias("_n"), F.max("_o.d").alias("_d"), F.min("_b").alias("_b"))
    return one.select(F.col("_id").alias(id_col), F.col("_own").alias(label),
                      _score(F.col("_n"), F.col("_d"), F.col("_b")).alias("score"))


def _score(n_own, d_own, b):
    a = d_own / (n_own - 1)
    return (F.when(n_own <= 1, F.lit(0.0))
            .when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b))
            .otherwise(F.lit(0.0)))


def _finish(id_col: str, label: str, sums: DataFrame) -> DataFrame:
    """sums: (id, own label, label c, n_c, sum of distances to c) -> silhouette."""
    own = (F.col("_c") == F.col(label))
    per = sums.groupBy(id_col, label).agg(
        F.max(F.when(own, F.col("_n"))).alias("_n_own"),
        F.max(F.when(own, F.col("_d"))).alias("_d_own"),
        F.min(F.when(~own & (F.col("_n") > 0), F.col("_d") / F.col("_n"))).alias("_b"))
    return per.select(id_col, label, _score(F.col("_n_own"), F.col("_d_own"), F.col("_b")).alias("score"))


def silhouette_samples(df: DataFrame, id_col: str, vec: str, label: str, metric: str = "euclidean",
                       block_rows: int = 2048, block_labels: int = 256) -> DataFrame:
    """(id, label, score) per sample; ``id_col`` is unique. Singleton label -> 0; needs two or more labels."""
    if metric == "sqeuclidean":
        return _linear_silhouette(df, id_col, vec, label, block_labels)
    if metric != "euclidean":
        raise ValueError("metric must be 'euclidean' or 'sqeuclidean'")
    n = df.count()
    nb = max(1, math.ceil(n / block_rows))
    blk = F.pmod(F.xxhash64(F.col(id_col)), F.lit(nb)).cast("int")
    base = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_lab"),
                     F.col(vec).alias("_x"), blk.alias("_blk"))
    others = F.sequence(F.lit(0), F.lit(nb - 1))
    left = base.select("*", F.lit(0).alias("_role"), F.col("_blk").alias("_p"), F.explode(others).alias("_q"))
    right = base.select("*", F.lit(1).alias("_role"), F.explode(others).alias("_p"), F.col("_blk").alias("_q"))
    out_schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType),
                               T.StructField("_c", df.schema[label].dataType),
                               T.StructField("_n", T.LongType()), T.StructField("_d", T.DoubleType())])

    def block_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        L = pdf[pdf["_role"] == 0]
        R = pdf[pdf["_role"] == 1]
        if len(L) == 0 or len(R) == 0:
            return pd.DataFrame({k: [] for k in out_schema.fieldNames()})
        xl = np.stack(L["_x"].to_numpy()).astype(np.float64)
        xr = np.stack(R["_x"].to_numpy()).astype(np.float64)
        d2 = (xl * xl).sum(1)[:, None] + (xr * xr).sum(1)[None, :] - 2.0 * xl @ xr.T
        d = np.sqrt(np.maximum(d2, 0.0))
        d[L["_id"].to_numpy()[:, None] == R["_id"].to_numpy()[None, :]] = 0.0
        labs = R["_lab"].to_numpy()
        parts = []
        for c in pd.unique(labs):
            m = labs == c
            parts.append(pd.DataFrame({"_id": L["_id"].to_numpy(), "_c": c,
                                       "_n": int(m.sum()), "_d": d[:, m].sum(1)}))
        return pd.concat(parts, ignore_index=True)

    partial = (left.unionByName(right).groupBy("_p", "_q").applyInPandas(block_pair, out_schema))
    sums = (partial.groupBy("_id", "_c").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"))
            .join(base.select("_id", "_lab"), "_id")
            .withColumnRenamed("_id", id_col).withColumnRenamed("_lab", label))
    return _finish(id_col, label, sums)


def silhouette(df: DataFrame, id_col: str, vec: str, label: str, metric: str = "euclidean",
               **kw) -> DataFrame:
    """(id, label, score, label_avg): per-sample score and its label's mean score."""
    # per-sample scores are stored once: the per-label means and the join both read them
    s = cut_lineage(silhouette_samples(df, id_col, vec, label, metric, **kw))
    avg = s.groupBy(label).agg(F.avg("score").alias("label_avg"))
    return s.join(avg, label)


def project_2d(df: DataFrame, vec: str, k: int = 2, name: str = "xy") -> DataFrame:
    """PCA projection to ``k`` dimensions (Spark ML), as ``array<double>``.

    An axis has no sign of its own: the component of largest size (the first of equals) is made
    positive, so that every solver gives the same coordinates.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = df.withColumn("_v", array_to_vector(F.col(vec)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    axes = model.pc.toArray()
    signs = np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    turned = F.zip_with(vector_to_array("_p"), F.array(*(F.lit(float(x)) for x in signs)), lambda x, sign: x * sign)
    return model.transform(v).withColumn(name, turned).drop("_v", "_p")
