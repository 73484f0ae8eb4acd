"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on: AQE re-plans joins and partition counts from
# runtime sizes, skew-join splitting handles hot keys, UTC keeps timestamps comparable.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "comboscore", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are only set when given, so a cluster
    submit keeps its own values.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set to shared storage; an unset folder is an error there, as
    files in a machine's own folder are not seen by others. Only in local mode (tests) a
    fresh scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="run-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    The result survives executor loss (the files are on shared storage), its lineage is
    one scan, and the planner sees its real size, so later broadcast decisions are based
    on measured bytes. The shuffles of the write go with it: they would stay on disk until the
    driver's next garbage collection.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("error").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


ROWS_PER_TASK = 100_000


def deal(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into a task for every ``ROWS_PER_TASK`` of ``rows``, and no fewer
    than the session's shuffle partitions.

    For narrow rows that grow after the shuffle (a list becomes its pairs): adaptive coalescing
    goes by the narrow bytes, and would leave few tasks that sort many times as much.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_TASK)), *keys)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``comboscore`` importable in the Python workers (pandas UDFs, mapInPandas).

    The package is zipped once per process and added with ``addPyFile`` — the programmatic
    form of ``--py-files`` — so executors fetch it from the driver whatever their working
    directory is.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    path = os.path.join(tempfile.mkdtemp(prefix="run-pyfiles-"), "comboscore.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SHIPPED.add(key)
