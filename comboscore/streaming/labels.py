"""Structured Streaming forms of the row-local operators.

The reference has no stream processing. What carries over is that every row-local
operator (label words, first-line stripping, typo injection, pair labels) is a plain column
expression, so the same functions run unchanged on a streaming DataFrame. These helpers
wire a file source to a file sink with a checkpoint in the shared checkpoint folder, so a
restarted query resumes where it stopped (exactly-once file sink).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comboscore.functions import text as TX
from comboscore.session import checkpoint_dir


def label_stream(stream: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label): the keyword label of every arriving answer (stateless)."""
    return stream.select(key, TX.keyword_label(TX.strip_first_line(F.col(text))).alias("label"))


def run_file_stream(spark: SparkSession, source_dir: str, schema: T.StructType, transform,
                    sink_dir: str | None = None, fmt: str = "parquet") -> str:
    """Process every file now in ``source_dir`` with ``transform`` and stop
    (``availableNow``); returns the sink folder. Re-running picks up only new files."""
    base = os.path.join(checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    sink_dir = sink_dir or os.path.join(base, "out")
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    q = (transform(src).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
    return sink_dir
