"""Projection operators (PRJ-01 .. PRJ-18): pure ``select`` rewrites.

Everything is a single projection over the input, so Catalyst collapses
these into the neighbouring scan / window stage and prunes unused columns
(including nested struct fields) down to the parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airwise.functions import dates as D
from airwise.functions import mathx as M
from airwise.functions import strings as S

# Canonical daily columns and their null defaults.
DAILY_COLUMNS = ["location_id", "latitude", "longitude", "zip_code", "date", "PM2_5_mean", "PM2_5_max",
                 "AQI", "temp_min", "temp_max", "humidity", "wind", "pressure", "rain", "pollen_tree",
                 "pollen_grass", "pollen_weed", "day_of_week", "month", "season", "holiday_flag"]
DAILY_DEFAULTS = {"PM2_5_mean": 0.0, "PM2_5_max": 0.0, "AQI": 50.0, "temp_min": 15.0, "temp_max": 20.0,
                  "humidity": 50.0, "wind": 0.0, "pressure": 101325.0, "rain": 0.0, "pollen_tree": 0.0,
                  "pollen_grass": 0.0, "pollen_weed": 0.0, "holiday_flag": False}

ENV_FLAT = [("air_quality", "pm25_mean"), ("air_quality", "pm25_max"), ("air_quality", "aqi"),
            ("air_quality", "aqi_24h_trend"), ("weather", "temp_min_c"), ("weather", "temp_max_c"),
            ("weather", "humidity_mean"), ("weather", "humidity_max"), ("weather", "wind_speed_kmh"),
            ("weather", "pressure_pa"), ("weather", "rain_mm"), ("pollen", "tree_index"),
            ("pollen", "grass_index"), ("pollen", "weed_index"), ("time_context", "day_of_week_num"),
            ("time_context", "season"), ("time_context", "is_holiday")]


def nest_env(daily: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Canonical daily rows -> nested environment documents (the landed layout)."""
    return daily.select(
        S.location_key("latitude", "longitude", "zip_code").alias("locationKey"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "latitude", "longitude", F.col("zip_code").alias("zipCode"),
        F.struct(F.col("PM2_5_mean").alias("pm25_mean"), F.col("PM2_5_max").alias("pm25_max"),
                 F.col("AQI").cast("int").alias("aqi"), F.lit(None).cast("string").alias("aqi_24h_trend"),
                 F.lit("derived").alias("source"), F.lit(None).cast("string").alias("error")).alias("air_quality"),
        F.struct(F.col("temp_min").alias("temp_min_c"), F.col("temp_max").alias("temp_max_c"),
                 F.col("humidity").alias("humidity_mean"), F.col("humidity").alias("humidity_max"),
                 F.col("wind").alias("wind_speed_kmh"), F.col("pressure").alias("pressure_pa"),
                 F.col("rain").alias("rain_mm"), F.lit("derived").alias("source"),
                 F.lit(None).cast("string").alias("error")).alias("weather"),
        F.when(F.col("pollen_tree").isNotNull() | F.col("pollen_grass").isNotNull(),
               F.struct(F.col("pollen_tree").alias("tree_index"), F.col("pollen_grass").alias("grass_index"),
                        F.col("pollen_weed").alias("weed_index"), F.lit("derived").alias("source"),
                        F.lit(None).cast("string").alias("error"))).alias("pollen"),
        D.time_context("date").alias("time_context"),
        (ingested_at if ingested_at is not None else F.to_timestamp(F.col("date"))).alias("ingestedAt"),
    )


def flatten_env(docs: DataFrame) -> DataFrame:
    """PRJ-01: nested env doc -> 2 keys + 17 values; a missing sub-document gives nulls."""
    return docs.select("date", "locationKey", *[F.col(f"{s}.{f}").alias(f) for s, f in ENV_FLAT])


def to_daily_row(pulled: DataFrame) -> DataFrame:
    """PRJ-02: pull-result layout (nested, pull names) -> canonical daily row."""
    return pulled.select(
        S.location_id("latitude", "longitude", "zipCode").alias("location_id"),
        "latitude", "longitude", F.col("zipCode").alias("zip_code"),
        F.to_date("date").alias("date"),
        F.col("air_quality.pm25_mean").alias("PM2_5_mean"), F.col("air_quality.pm25_max").alias("PM2_5_max"),
        F.col("air_quality.aqi").cast("double").alias("AQI"),
        F.col("weather.temp_min_c").alias("temp_min"), F.col("weather.temp_max_c").alias("temp_max"),
        F.col("weather.humidity_mean").alias("humidity"), F.col("weather.wind_speed_kmh").alias("wind"),
        F.col("weather.pressure_pa").alias("pressure"), F.col("weather.rain_mm").alias("rain"),
        F.col("pollen.tree_index").alias("pollen_tree"), F.col("pollen.grass_index").alias("pollen_grass"),
        F.col("pollen.weed_index").alias("pollen_weed"),
        F.col("time_context.day_of_week").alias("day_of_week"), F.month(F.to_date("date")).alias("month"),
        F.col("time_context.season").alias("season"),
        F.coalesce(F.col("time_context.is_holiday"), F.lit(False)).alias("holiday_flag"),
    )


def to_week_row(daily: DataFrame) -> DataFrame:
    """PRJ-03: daily row -> weekly/flare layout (date text, dash location, bool holiday)."""
    return daily.select(
        S.dash_form("location_id").alias("locationid"), "latitude", "longitude", "zip_code",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[c for c in DAILY_COLUMNS[5:17]],
        D.weekday_name("date").alias("day_of_week"), F.month("date").alias("month"),
        D.season_name(F.month("date")).alias("season"),
        F.coalesce(F.col("holiday_flag").cast("boolean"), F.lit(False)).alias("holiday_flag"),
    )


def strip_raw(df: DataFrame, struct_cols: Sequence[str] = ()) -> DataFrame:
    """PRJ-04: drop the raw payload field (top level and inside structs)."""
    out = df.drop("raw")
    for c in struct_cols:
        fields = [f.name for f in out.schema[c].dataType.fields]
        if "raw" in fields:
            out = out.withColumn(c, F.col(c).dropFields("raw"))
    return out


def fill_daily_defaults(df: DataFrame) -> DataFrame:
    """PRJ-05: per-column defaults, weekday/month/season from the date when missing."""
    out = df.na.fill({k: v for k, v in DAILY_DEFAULTS.items() if k in df.columns})
    d = F.col("date")
    return out.select(
        *[c for c in out.columns if c not in ("day_of_week", "month", "season")],
        F.coalesce(F.col("day_of_week"), D.weekday_name(d)).alias("day_of_week"),
        F.coalesce(F.col("month"), F.month(d), F.lit(0)).alias("month"),
        F.coalesce(F.col("season"), D.season_name(F.month(d))).alias("season"),
    )


PROFILE_KEYS = ["name", "height", "weight", "gender", "smokerStatus", "petExposure"]


def widen_profile(users: DataFrame, keys: Sequence[str] = PROFILE_KEYS) -> DataFrame:
    """PRJ-06: profile struct -> profile_<key> columns (nested pruning reads only these)."""
    return users.select("user_id", *[F.col(f"profile.{k}").alias(f"profile_{k}") for k in keys])


def coerce_checkins(df: DataFrame, cols: Sequence[str] = ("wheeze", "cough", "chestTightness", "exerciseMinutes")) -> DataFrame:
    """PRJ-07: symptom columns to numbers; bad/missing -> 0; absent column -> 0."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[
        (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in cols])


def checkin_rows(df: DataFrame) -> DataFrame:
    """PRJ-08: date else updatedAt day; no date -> dropped; rescueUsed bool; score double (0)."""
    date_txt = F.coalesce(F.nullif(F.col("date").cast("string"), F.lit("")),
                          F.date_format("updatedAt", "yyyy-MM-dd"))
    return df.select(date_txt.alias("date"), F.col("userId"),
                     F.coalesce(F.col("rescueUsed").cast("boolean"), F.lit(False)).alias("rescueUsed"),
                     F.coalesce(F.col("symptomScore").try_cast("double"), F.lit(0.0)).alias("symptomScore")) \
        .where(F.col("date").isNotNull())


def order_columns(df: DataFrame, first: Sequence[str], constants: dict | None = None) -> DataFrame:
    """PRJ-09: known columns first (those present), then the others; constants appended."""
    head = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in head]
    consts = [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return df.select(*head, *rest, *consts)


def align_features(df: DataFrame, feature_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-10: exactly ``feature_cols`` in order: missing -> 0, numeric coercion, null -> 0.
    Booleans become 0/1.  ``keep`` columns (ids) are carried in front."""
    types = dict(df.dtypes)
    cols = []
    for c in feature_cols:
        if c not in types:
            cols.append(F.lit(0.0).alias(c))
        elif types[c] == "boolean":
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        else:
            cols.append(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c))
    return df.select(*keep, *cols)


def missing_features(df: DataFrame, feature_cols: Sequence[str]) -> list[str]:
    """PRJ-10 report: saved features absent from the frame (schema only, no job)."""
    return [c for c in feature_cols if c not in df.columns]


# Alias groups (canonical name first).
ALIASES = [("location_id", "locationid"), ("AQI", "aqi"), ("temp_min", "temp_min_c"),
           ("temp_max", "temp_max_c"), ("humidity", "humidity_mean"), ("wind", "wind_speed_kmh"),
           ("PM2_5_mean", "pm25_mean"), ("PM2_5_max", "pm25_max")]


def normalize_columns(df: DataFrame, trend_col: str | None = None, trend_default: float = 50.0) -> DataFrame:
    """PRJ-11: rename alias spellings to the canonical names; add holiday_flag=false
    and the trends column (default 50) when absent."""
    out = df
    for canon, alt in ALIASES:
        if canon not in out.columns and alt in out.columns:
            out = out.withColumnRenamed(alt, canon)
    if "holiday_flag" not in out.columns:
        out = out.withColumn("holiday_flag", F.lit(False))
    if trend_col and trend_col not in out.columns:
        out = out.withColumn(trend_col, F.lit(trend_default))
    return out


def trend_column_name(keyword: str) -> str:
    """PRJ-12: google_trends_<keyword with spaces as _>."""
    return "google_trends_" + keyword.replace(" ", "_")


def rename_trend(df: DataFrame, keyword: str, src: str = "trend") -> DataFrame:
    """PRJ-12: dynamic rename of the trends column."""
    return df.withColumnRenamed(src, trend_column_name(keyword))


def daily_doc(df: DataFrame) -> Column:
    """PRJ-13: the daily struct of an output record; weekday and season come from
    indices (mod 7 / mod 4) as the scoring side stores them."""
    dow_idx = F.coalesce(F.col("day_of_week").try_cast("int"), D.weekday_num("date"))
    season_idx = F.coalesce(F.col("season").try_cast("int"), D.season_num(F.month("date"), zero_based=True))
    return F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[F.col(c) for c in ["PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind",
                             "pressure", "rain", "pollen_tree", "pollen_grass", "pollen_weed"]],
        M.category_name(dow_idx, D.WEEKDAY_NAMES).alias("day_of_week"),
        M.category_name(season_idx, D.SEASON_NAMES).alias("season"),
        F.coalesce(F.col("holiday_flag"), F.lit(False)).alias("holiday_flag"),
    )


def risk_record(date: Column, p: Column, factors: Column, daily: Column) -> Column:
    """PRJ-14: {date, risk{score, level, label}, activeRiskFactors[], daily{}}."""
    return F.struct(date.alias("date"), M.risk_struct(p).alias("risk"), factors.alias("activeRiskFactors"),
                    daily.alias("daily"))


ID_COLUMNS = {"location_id", "locationid", "user_id", "date", "zip_code", "latitude", "longitude"}


def feature_columns(df: DataFrame, target: str | None = None, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """PRJ-15: (numeric, categorical) feature lists by exclusion of ids, date,
    target and *_tomorrow columns; split on the column types."""
    skip = set(ID_COLUMNS) | set(exclude) | ({target} if target else set())
    num, cat = [], []
    for c, t in df.dtypes:
        if c in skip or c.endswith("_tomorrow"):
            continue
        (cat if t == "string" else num).append(c)
    return num, cat


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-16: numeric nulls -> exact column median (0 when the column is all null).
    All medians come from one pass, as one scalar map that is named once."""
    from airwise.operators.quantiles import fill_with, medians
    from airwise.operators.windows import free_name
    meds = free_name(df, "_medians")
    return df.withColumn(meds, medians(df, cols)).select(*[fill_with(F.col(meds), c) if c in cols else F.col(c) for c in df.columns])


def pick_score(df: DataFrame, target: str | None = None) -> Column:
    """PRJ-18: the score column by target: risk, else flare_day, else 0."""
    cols = [c for c in ([target] if target else []) + ["risk", "flare_day"] if c in df.columns]
    return F.coalesce(*[F.col(c).cast("double") for c in cols], F.lit(0.0)) if cols else F.lit(0.0)


def as_daily_schema() -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in [
        ("location_id", T.StringType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType()),
        ("zip_code", T.StringType()), ("date", T.DateType())]
        + [(c, T.DoubleType()) for c in DAILY_COLUMNS[5:17]]
        + [("day_of_week", T.StringType()), ("month", T.IntegerType()), ("season", T.StringType()),
           ("holiday_flag", T.BooleanType())]])
