"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_views: bool = True):
    """Register a query (spark, sf_dir) under its name, with SQL over the views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return plain(f(spark, d))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = (views.SQL.rstrip() + ("," + sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else "\n" + sql)) if with_views else sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, others as DOUBLE rounded to six places: the binary product with a million, halves away from zero, as SQL engines do."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal") and kind.endswith(",0)"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double") * 1e6) / 1e6 + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def R(e: str) -> str:
    """SQL: rounded like plain()."""
    return f"(round(({e})::DOUBLE, 6) + 0)"
