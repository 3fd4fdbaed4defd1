"""Feature pipelines (FE-01 .. FE-03) built from shared window specs.

Each pipeline is one ``select`` per window pass so the plan stays narrow:
Catalyst groups every window expression with the same spec into one
Window operator (one sort per series).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airwise.functions import mathx as M
from airwise.operators import windows as W

POLLEN_COLS = ["pollen_tree", "pollen_grass", "pollen_weed"]


def pollen_missing_flags(df: DataFrame) -> DataFrame:
    """PRJ-17: <c>_missing = is null (absent column = all missing), then fill 0."""
    cols = []
    for c in POLLEN_COLS:
        src = F.col(c) if c in df.columns else F.lit(None).cast("double")
        cols.append(src.isNull().cast("int").alias(f"{c}_missing"))
        cols.append(F.coalesce(src, F.lit(0.0)).alias(c))
    keep = [c for c in df.columns if c not in POLLEN_COLS]
    return df.select(*keep, *cols)


def drop_incomplete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """FLT-04: rows without a null or NaN in ``cols``, as ``na.drop``, with a condition for each column: where columns get new names,
    the optimizer derives one condition over k columns anew for each subset of them (2^k), single ones once."""
    real = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull() & (~F.isnan(c) if c in real else F.lit(True))
    return df.where(keep)


GENERAL_FEATURES = [
    "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind", "pressure", "rain",
    "pollen_tree", "pollen_grass", "pollen_weed", "pollen_tree_missing", "pollen_grass_missing",
    "pollen_weed_missing", "pollen_total", "temp_swing", "pm25_x_humidity", "pollen_x_wind",
    "pm25_mean_lag1", "pm25_max_lag1", "aqi_lag1", "pollen_lag1", "pm25_delta",
    "pm25_mean_roll3_mean", "pm25_mean_roll3_max", "aqi_roll3_mean", "aqi_roll3_max",
    "pm25_mean_roll7_mean", "pm25_mean_roll7_max", "aqi_roll7_mean", "aqi_roll7_max",
]


def env_features_general(df: DataFrame, key: str = "location_id", drop_incomplete: bool = True) -> DataFrame:
    """FE-01: pollen flags, derived measures, lag/delta/full rolling windows per series.

    Rows with a null in any feature column are dropped (Q5: only feature
    columns count, so a null zip code does not remove a row)."""
    base = pollen_missing_flags(df)
    base = base.select(
        "*",
        M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed").alias("pollen_total"),
        (F.col("temp_max") - F.col("temp_min")).alias("temp_swing"),
        (F.col("PM2_5_mean") * F.col("humidity")).alias("pm25_x_humidity"),
    ).withColumn("pollen_x_wind", F.col("pollen_total") * F.col("wind"))
    w = W.series(key)
    win_cols = [
        W.lag("PM2_5_mean", w).alias("pm25_mean_lag1"),
        W.lag("PM2_5_max", w).alias("pm25_max_lag1"),
        W.lag("AQI", w).alias("aqi_lag1"),
        W.lag("pollen_total", w).alias("pollen_lag1"),
        W.delta("PM2_5_mean", w).alias("pm25_delta"),
    ]
    for n in (3, 7):
        win_cols += [
            W.rolling_full("PM2_5_mean", w, n, "avg").alias(f"pm25_mean_roll{n}_mean"),
            W.rolling_full("PM2_5_mean", w, n, "max").alias(f"pm25_mean_roll{n}_max"),
            W.rolling_full("AQI", w, n, "avg").alias(f"aqi_roll{n}_mean"),
            W.rolling_full("AQI", w, n, "max").alias(f"aqi_roll{n}_max"),
        ]
    out = base.select("*", *win_cols)
    if drop_incomplete:
        out = drop_incomplete_rows(out, GENERAL_FEATURES)
    return out


FLARE_BASE_COLS = [
    "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "temp_range", "humidity", "wind",
    "pressure", "rain", "pm_spike", "humid_x_pm", "wind_x_pm", "pollen_tree", "pollen_grass", "pollen_weed",
]


def flare_derived(df: DataFrame) -> DataFrame:
    """FE-02 step 1: derived measures (MA-13/14) and pollen flags."""
    pm0 = F.coalesce(F.col("PM2_5_mean"), F.lit(0.0)) + 1e-6
    out = df.select(
        "*",
        (F.col("temp_max") - F.col("temp_min")).alias("temp_range"),
        (F.col("PM2_5_max") - F.col("PM2_5_mean")).alias("pm_spike"),
        (F.col("humidity") * pm0).alias("humid_x_pm"),
        (F.col("wind") * pm0).alias("wind_x_pm"),
    )
    return pollen_missing_flags(out)


def env_features_flare(df: DataFrame, key: str = "location_id") -> DataFrame:
    """FE-02: 16 columns x (lag1, lag2, full roll3 mean, full roll7 mean), then rows with any null
    feature dropped (FLT-04).  The fallback for short series (FLT-05) is ``flare_features_or_fallback``."""
    rows, feats = _flare_rows(df, key)
    return drop_incomplete_rows(rows, feats)


def _flare_rows(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """All rows with the features, and the features' names.  The 3-row and 7-row means follow from the value and its
    lags, added from the oldest on as a frame does (a null among them is a null mean): a sliding frame of 7 rows would add every value seven times
    through an aggregate buffer."""
    base = flare_derived(df)
    w = W.series(key)
    back = {(c, i): W.free_name(base, f"{c}_lag{i}") if i > 2 else f"{c}_lag{i}" for c in FLARE_BASE_COLS for i in range(1, 7)}
    out = base.select("*", *[W.lag(c, w, i).alias(name) for (c, i), name in back.items()])

    def mean(c: str, n: int, start: Column) -> Column:
        for i in range(n - 1, 0, -1):
            start = start + F.col(back[c, i])
        return (start + F.col(c)) / float(n)

    means = {f"{c}_roll3": (F.col(f"{c}_lag2") + F.col(f"{c}_lag1") + F.col(c)) / 3.0 for c in FLARE_BASE_COLS}
    means |= {f"{c}_roll7": mean(c, 7, F.lit(0.0)) for c in FLARE_BASE_COLS}
    feats = FLARE_BASE_COLS + [f"{c}_{s}" for c in FLARE_BASE_COLS for s in ("lag1", "lag2", "roll3", "roll7")]
    return out.select(*base.columns, *[means[f].alias(f) if f in means else F.col(f) for f in feats if f not in base.columns]), feats


def flare_features_or_fallback(df: DataFrame, key: str = "location_id") -> DataFrame:
    """FLT-05, decided per series: a series with at least one row whose features are all there keeps
    those rows; a shorter one keeps all its rows with the un-lagged features, nulls set to 0 and
    the lagged columns null.  ``full_history`` tells which.  One window over the series counts its
    full rows, so one long series doesn't turn the fallback off for the others, and nothing runs
    before the plan does."""
    rows, feats = _flare_rows(df, key)
    whole = F.lit(True)
    for c in feats:
        whole = whole & F.col(c).isNotNull()
    marked = rows.withColumn("_whole", whole)
    marked = marked.withColumn("full_history", F.max("_whole").over(Window.partitionBy(key)))
    kept = marked.where(F.col("_whole") | ~F.col("full_history")).drop("_whole")
    zero = {t.name: F.lit(False) if t.dataType.simpleString() == "boolean" else F.lit(0).cast(t.dataType)
            for t in kept.schema.fields if t.dataType.simpleString() in ("boolean", "int", "bigint", "double", "float")}
    lagged = set(feats) - set(FLARE_BASE_COLS)
    return kept.select(*[F.when(F.col("full_history"), F.col(c)).otherwise(F.coalesce(F.col(c), zero[c])).alias(c)
                         if c in zero and c not in lagged and c != "full_history" else F.col(c) for c in kept.columns])


def user_time_features(df: DataFrame, key: str | None = "user_id") -> DataFrame:
    """FE-03: per-user env time features (zero-start lags/deltas, shifted partial rolling
    means), pollen total and interactions (WN-03/04/07, MA-13/14).  key=None
    is the single-series variant (WN-08)."""
    w = W.series(key)
    base = df.select(
        "*",
        (F.col("temp_max") - F.col("temp_min")).alias("temp_swing"),
        M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed").alias("pollen_total"),
    )
    return base.select(
        "*",
        W.delta("PM2_5_mean", w, zero=True).alias("pm25_delta"),
        W.rolling_prev("PM2_5_mean", w, 3).alias("pm25_roll3_mean"),
        W.rolling_prev("PM2_5_mean", w, 7).alias("pm25_roll7_mean"),
        W.lag0("PM2_5_mean", w).cast("double").alias("pm25_lag1"),
        W.rolling_prev("AQI", w, 3).alias("aqi_roll3_mean"),
        W.rolling_prev("AQI", w, 7).alias("aqi_roll7_mean"),
        W.lag0("AQI", w).cast("double").alias("aqi_lag1"),
        W.lag0("pollen_total", w).cast("double").alias("pollen_total_lag1"),
        (F.col("PM2_5_mean") * F.col("humidity")).alias("pm25_x_humidity"),
        (F.col("pollen_total") * F.col("wind")).alias("pollen_x_wind"),
    )


SYMPTOM_COLS = ["wheeze", "cough", "chestTightness", "exerciseMinutes"]


def symptom_lags(df: DataFrame, key: str = "user_id") -> DataFrame:
    """FE-03/FE-04: per-user zero-start lags of the symptoms and the symptom score."""
    w = W.series(key)
    base = df.withColumn("symptom_score", F.col("wheeze") + F.col("cough") + F.col("chestTightness"))
    return base.select("*", *[W.lag0(c, w).alias(f"{c}_lag1") for c in SYMPTOM_COLS],
                       W.lag0("symptom_score", w).alias("symptom_score_lag1"))
