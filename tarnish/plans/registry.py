"""Registration of runnable queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query `(spark, sf_dir) -> DataFrame` and, where SQL can express it, its check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of floating-point sums do not matter in a comparison."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def exact_text(df: DataFrame) -> DataFrame:
    """Pair counts beyond 64 bits as exact text."""
    wide = {f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"}
    return df.select(*[F.col(c).cast("string").alias(c) if c in wide else F.col(c) for c in df.columns])
