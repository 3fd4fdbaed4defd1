"""FE-05: severity feature vectors from check-ins and the last env row per date."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import labels as L
from airwise.operators import joins as J
from airwise.sources import tables as T

# Feature order of the severity vector.
SEVERITY_FEATURES = ["aqi", "pm25", "tree_index", "grass_index", "weed_index", "weighted_pollen", "humidity",
                     "wind_speed_kmh", "rain_mm", "temp_max_c", "symptom_score_today"]


def _or(a, b):
    """Python-style ``a or b`` on numbers: 0 or null falls through to b."""
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def severity_features(spark, d):
    env = T.env_daily(spark, d).select("date", F.col("AQI").alias("aqi"), F.col("PM2_5_mean").alias("pm25_mean"),
                     F.col("PM2_5_max").alias("pm25_max"), F.col("pollen_tree").alias("tree"),
                     F.col("pollen_grass").alias("grass"), F.col("pollen_weed").alias("weed"),
                     F.col("humidity").alias("humidity_mean"), (F.col("humidity") + 5).alias("humidity_max"),
                     "wind", "rain", "temp_max", F.col("latitude").alias("ingestedAt"))
    c = T.checkins(spark, d).select("user_id", "date", "symptomScore")
    j = J.join_last_env(c, env, order="ingestedAt")
    z = F.lit(0.0)
    tree, grass, weed = (F.coalesce(F.col(x), z) for x in ("tree", "grass", "weed"))
    feats = {
        "aqi": F.coalesce(F.col("aqi"), z),
        "pm25": F.coalesce(_or(F.col("pm25_mean"), F.col("pm25_max")), z),
        "tree_index": tree, "grass_index": grass, "weed_index": weed,
        "weighted_pollen": tree + grass + weed,
        "humidity": F.coalesce(_or(F.col("humidity_mean"), F.col("humidity_max")), z),
        "wind_speed_kmh": F.coalesce(F.col("wind"), z), "rain_mm": F.coalesce(F.col("rain"), z),
        "temp_max_c": F.coalesce(F.col("temp_max"), z),
        "symptom_score_today": F.coalesce(F.col("symptomScore"), z),
    }
    return j.select("user_id", "date", *[feats[k].alias(k) for k in SEVERITY_FEATURES],
                    L.severe("symptomScore").alias("y"))


