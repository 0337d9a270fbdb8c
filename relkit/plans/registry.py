"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each query module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, the equivalent SQL.  Double columns are
rounded to 6 digits on both sides (summation order differs between engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str | Callable[[], str]] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        _QUERIES[name] = wrapped
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load_all():
    # import for side effects (registration)
    from relkit.plans import (q_agreement, q_corpus, q_files, q_judge, q_retrieval,  # noqa: F401
                              q_sources, q_tables)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: (v() if callable(v) else v) for k, v in _ORACLE.items()}
