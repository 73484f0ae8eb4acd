"""Caller-supplied Python functions over a table, Arrow-batched.

The library ships no model. ``map_batches`` hands each Arrow batch (as pandas) to the
caller's function — e.g. a text generator — and ``map_column`` wraps a per-value function
as a pandas UDF. Both run inside Spark tasks; prefer column expressions whenever one
exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply ``fn`` to every batch of rows; ``schema`` describes its output."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def map_column(col, fn: Callable, return_type="string") -> Column:
    """Per-value Python function as an Arrow-batched UDF (NULL in -> NULL out)."""
    @F.pandas_udf(return_type)
    def _f(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))
    return _f(F.col(col) if isinstance(col, str) else col)
