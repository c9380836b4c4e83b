"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


def _spec(columns: str) -> list[tuple[str, str]]:
    """``"a:i b:d4 c:s"``: whole numbers, doubles rounded to so many digits (6), texts."""
    return [tuple(c.split(":")) for c in columns.split()]


def register(name: str, columns: str, sql: str | None = None):
    """Register a query; its result and its oracle's are brought to the same columns and types."""

    def done(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = []
            for c, kind in _spec(columns):
                if kind[0] == "d":
                    out.append((F.round(F.col(c).cast("double"), int(kind[1:] or 6)) + 0.0).alias(c))
                else:
                    out.append(F.col(c).cast("string" if kind == "s" else "long").alias(c))
            return query(spark, sf_dir).select(*out)

        _QUERIES[name] = run
        if sql:
            out = []
            for c, kind in _spec(columns):
                digits = kind[1:] or 6
                out.append(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" if kind[0] == "d" else f"{c}::{'VARCHAR' if kind == 's' else 'BIGINT'} AS {c}")
            head, _, body = sql.rpartition("--")
            _ORACLES[name] = f"{'WITH ' + head if head else ''}SELECT {', '.join(out)} FROM ({body})"
        return query

    return done


def load() -> None:
    """Import the modules that register queries."""
    from . import attribute_queries, geometry_queries, model_queries, series_queries, spatial_queries  # noqa: F401
