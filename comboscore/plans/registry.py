"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from comboscore.session import ship_package

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    """Decorator: register a ``(spark, sf_dir) -> DataFrame`` builder under ``name``."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # Python workers must be able to import the package
            return fn(spark, sf_dir)
        REGISTRY[name] = Entry(name, build, sql, note)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the query modules fills REGISTRY
    from comboscore.plans import queries  # noqa: F401
    return REGISTRY
