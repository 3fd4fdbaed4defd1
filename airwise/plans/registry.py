"""Named queries and their SQL oracles.

``@query(name, sql, views)`` registers a Spark builder ``fn(spark, sf_dir)``
and, when given, an ANSI SQL twin (DuckDB dialect) that reads the same raw
tables.  Doubles are rounded to 6 decimals at the very end of both sides so
the comparison does not depend on floating-point summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airwise.plans.sqlviews import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}  # without the comparison rounding
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def round6(c):
    """sign(x) * floor(|x| * 1e6 + 0.5) / 1e6 (half away from zero on the binary product),
    +0.0 folds -0.0.  This is the arithmetic of DuckDB's round(x, 6), so equal inputs give
    equal bits, and it stays in generated code (no per-value BigDecimal)."""
    x = c.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def finish(df: DataFrame) -> DataFrame:
    """Round floating columns to 6 dp (comparison hygiene, not semantics)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = (), bench: bool = False):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return finish(_fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        RAW[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        if bench:
            BENCH.append(name)
        return fn
    return deco
