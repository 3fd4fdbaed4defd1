"""Scans (SRC-01 .. SRC-05): schema-first reads with pushed-down predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airwise.sources.tables import nan_to_null


class EmptySourceError(RuntimeError):
    pass


def read_daily_env(spark: SparkSession, path: str, location_id: str | None = None,
                   schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC-01: daily env scan with optional location equality; error when empty.

    The emptiness test is ``isEmpty`` (a limit-1 job that stops at the first
    row), not a count."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if location_id is not None:
        df = df.where(F.col("location_id") == location_id)  # before any projection: pushed down
    df = nan_to_null(df.withColumn("date", F.to_date("date")))
    if df.isEmpty():
        raise EmptySourceError(f"no rows in {path} for location_id={location_id}")
    return df


def read_env_range(df: DataFrame, start, end, col: str = "date") -> DataFrame:
    """SRC-02: both ends inclusive (partition pruning on a date-partitioned table)."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_env_last_days(df: DataFrame, asof, n: int, col: str = "date") -> DataFrame:
    """SRC-02 variant: the n days ending at ``asof`` (inclusive)."""
    a = F.lit(asof).cast("date")
    return df.where(F.col(col).between(F.date_sub(a, n - 1), a))


def read_users(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-03: users with only profile + checkIns projected (nested pruning)."""
    return spark.read.format(fmt).load(path).select(F.col("_id").alias("user_id"), "profile", "checkIns")


CHECKIN_SCHEMA = T.StructType([
    T.StructField("userId", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("updatedAt", T.TimestampType()), T.StructField("rescueUsed", T.BooleanType()),
    T.StructField("symptomScore", T.DoubleType())])


def read_checkins(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC-04: older check-in layout with an explicit schema."""
    return spark.read.format(fmt).schema(CHECKIN_SCHEMA).load(path)


def read_env_docs(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """SRC-04: nested environment documents."""
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema is not None else r).load(path)


def training_target(columns) -> str:
    """SRC-05: 'risk' if present, else 'flare_day', else an error."""
    if "risk" in columns:
        return "risk"
    if "flare_day" in columns:
        return "flare_day"
    raise ValueError("training data has neither 'risk' nor 'flare_day'")


def read_training_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> tuple[DataFrame, str]:
    """SRC-05: training CSV with header (schema given, never inferred at scale)."""
    r = spark.read.option("header", True)
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    return nan_to_null(df), training_target(df.columns)
