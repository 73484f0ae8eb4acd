"""comboscore: pair-interaction scoring and text evaluation as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` or ``Column -> Column``
built from the DataFrame / SQL API, so Catalyst plans the whole chain and Spark
distributes it. Python only runs inside Arrow-batched pandas UDFs where Spark has no
built-in (longest common subsequence, stemming, exact-Euclidean silhouette blocks).
"""

from comboscore.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
