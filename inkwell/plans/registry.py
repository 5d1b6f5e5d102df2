"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query with its SQL; ``dates`` are returned as text, so that no library's idea of a date stands between the two."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if sql:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            _ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if dates else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
