"""Queries: flagship outlook, feature pipelines, windows and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import arrays as A
from airwise.functions import labels as L
from airwise.functions import mathx as M
from airwise.operators import windows as W
from airwise.plans import features as FE
from airwise.operators import quantiles as Q
from airwise.plans.registry import query
from airwise.sources import tables as T

# ---------------------------------------------------------------- SQL pieces

FE01_SQL = """
fe_a AS (
  SELECT * REPLACE (coalesce(pollen_tree, 0) AS pollen_tree, coalesce(pollen_grass, 0) AS pollen_grass,
                    coalesce(pollen_weed, 0) AS pollen_weed),
         CAST(pollen_tree IS NULL AS INTEGER) AS pollen_tree_missing,
         CAST(pollen_grass IS NULL AS INTEGER) AS pollen_grass_missing,
         CAST(pollen_weed IS NULL AS INTEGER) AS pollen_weed_missing
  FROM {src}),
fe_b AS (
  SELECT *, pollen_tree + pollen_grass + pollen_weed AS pollen_total, temp_max - temp_min AS temp_swing,
         PM2_5_mean * humidity AS pm25_x_humidity,
         (pollen_tree + pollen_grass + pollen_weed) * wind AS pollen_x_wind
  FROM fe_a),
fe_c AS (
  SELECT *,
    lag(PM2_5_mean) OVER w AS pm25_mean_lag1, lag(PM2_5_max) OVER w AS pm25_max_lag1,
    lag(AQI) OVER w AS aqi_lag1, lag(pollen_total) OVER w AS pollen_lag1,
    PM2_5_mean - lag(PM2_5_mean) OVER w AS pm25_delta,
    CASE WHEN count(PM2_5_mean) OVER w3 = 3 THEN avg(PM2_5_mean) OVER w3 END AS pm25_mean_roll3_mean,
    CASE WHEN count(PM2_5_mean) OVER w3 = 3 THEN max(PM2_5_mean) OVER w3 END AS pm25_mean_roll3_max,
    CASE WHEN count(AQI) OVER w3 = 3 THEN avg(AQI) OVER w3 END AS aqi_roll3_mean,
    CASE WHEN count(AQI) OVER w3 = 3 THEN max(AQI) OVER w3 END AS aqi_roll3_max,
    CASE WHEN count(PM2_5_mean) OVER w7 = 7 THEN avg(PM2_5_mean) OVER w7 END AS pm25_mean_roll7_mean,
    CASE WHEN count(PM2_5_mean) OVER w7 = 7 THEN max(PM2_5_mean) OVER w7 END AS pm25_mean_roll7_max,
    CASE WHEN count(AQI) OVER w7 = 7 THEN avg(AQI) OVER w7 END AS aqi_roll7_mean,
    CASE WHEN count(AQI) OVER w7 = 7 THEN max(AQI) OVER w7 END AS aqi_roll7_max
  FROM fe_b
  WINDOW w AS (PARTITION BY {key} ORDER BY date),
         w3 AS (PARTITION BY {key} ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         w7 AS (PARTITION BY {key} ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
fe AS (
  SELECT * FROM fe_c WHERE {notnull})
"""

# The feature lists of FE-01 and FE-02, written out for the SQL twins.
FE01_SQL_FEATURES = [
    "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind", "pressure", "rain",
    "pollen_tree", "pollen_grass", "pollen_weed", "pollen_tree_missing", "pollen_grass_missing",
    "pollen_weed_missing", "pollen_total", "temp_swing", "pm25_x_humidity", "pollen_x_wind", "pm25_mean_lag1",
    "pm25_max_lag1", "aqi_lag1", "pollen_lag1", "pm25_delta", "pm25_mean_roll3_mean", "pm25_mean_roll3_max",
    "aqi_roll3_mean", "aqi_roll3_max", "pm25_mean_roll7_mean", "pm25_mean_roll7_max", "aqi_roll7_mean",
    "aqi_roll7_max",
]
FE02_SQL_COLS = [
    "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "temp_range", "humidity", "wind", "pressure",
    "rain", "pm_spike", "humid_x_pm", "wind_x_pm", "pollen_tree", "pollen_grass", "pollen_weed",
]

FE01_NOTNULL = " AND ".join(f"{c} IS NOT NULL" for c in FE01_SQL_FEATURES)

LB01_SQL = """
lb_a AS (
  SELECT *, lead(AQI) OVER w AS AQI_tomorrow, lead(PM2_5_mean) OVER w AS PM2_5_mean_tomorrow,
         lead(pollen_total) OVER w AS pollen_total_tomorrow
  FROM fe WINDOW w AS (PARTITION BY {key} ORDER BY date)),
lb AS (
  SELECT *, CAST(AQI_tomorrow >= 101 OR PM2_5_mean_tomorrow >= 35 OR pollen_total_tomorrow >= 8 AS INTEGER) AS y
  FROM lb_a
  WHERE AQI_tomorrow IS NOT NULL AND PM2_5_mean_tomorrow IS NOT NULL AND pollen_total_tomorrow IS NOT NULL)
"""


def fe01_sql(src: str, key: str = "location_id") -> str:
    return FE01_SQL.format(src=src, key=key, notnull=FE01_NOTNULL)


def lb01_sql(key: str = "location_id") -> str:
    return LB01_SQL.format(key=key)


PROBA_SQL = ("greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.15::DOUBLE + least(0.2::DOUBLE, coalesce(AQI, 0) / 400) "
             "+ least(0.15::DOUBLE, coalesce(PM2_5_mean, 0) / 200) + least(0.1::DOUBLE, coalesce(pollen_total, 0) / 80)))")


def score_sql(p: str) -> str:
    return (f"sround(CASE WHEN {p} < 0.2 THEN 1 + {p} * 5 WHEN {p} < 0.5 THEN 2 + ({p} - 0.2::DOUBLE) * 10 "
            f"ELSE 4 + ({p} - 0.5::DOUBLE) * 2 END, 1)")


def level_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.2 THEN 'low' WHEN {p} < 0.5 THEN 'moderate' ELSE 'high' END"


FACTORS5_SQL = ("coalesce(nullif(concat_ws(',', CASE WHEN AQI >= 101 THEN 'air' END, "
                "CASE WHEN PM2_5_mean >= 35 THEN 'pm25' END, CASE WHEN pollen_total >= 8 THEN 'pollen' END, "
                "CASE WHEN temp_min < 5 THEN 'temp' END, CASE WHEN humidity >= 80 THEN 'humidity' END), ''), 'general')")


# ---------------------------------------------------------------- flagship

def outlook(env):
    fe = FE.env_features_general(env)
    lab = L.high_risk_tomorrow(fe)
    p = M.rule_probability("AQI", "PM2_5_mean", "pollen_total")
    return lab.select(
        "location_id", "date", "PM2_5_mean", "AQI", "pollen_total", "pm25_mean_lag1", "pm25_delta",
        "pm25_mean_roll3_mean", "pm25_mean_roll7_max", "aqi_roll7_mean", "y",
        p.alias("proba"), M.proba_to_score(p).alias("score"), M.proba_to_level(p).alias("level"),
        A.factor_ids(A.risk_factors("AQI", "PM2_5_mean", "pollen_total", "temp_min", "humidity")).alias("factors"),
    )


OUTLOOK_SQL = "WITH " + fe01_sql("env_daily") + "," + lb01_sql() + f"""
SELECT location_id, date, PM2_5_mean, AQI, pollen_total, pm25_mean_lag1, pm25_delta,
       pm25_mean_roll3_mean, pm25_mean_roll7_max, aqi_roll7_mean, y,
       {PROBA_SQL} AS proba, {score_sql(PROBA_SQL)} AS score, {level_sql(PROBA_SQL)} AS level,
       {FACTORS5_SQL} AS factors
FROM lb"""


@query("fe_09_high_risk_outlook", OUTLOOK_SQL, ["env_daily"], bench=True)
def q_outlook(spark, d):
    """Flagship: which location-days are high risk tomorrow (FE-01 + LB-01 + MA-08/04 + AJ-01)."""
    return outlook(T.env_daily(spark, d))


OUTLOOK_BIG_SQL = OUTLOOK_SQL.replace("FROM env_daily", "FROM daily_big")


@query("fe_09_high_risk_outlook_big", OUTLOOK_BIG_SQL, ["daily_big"], bench=True)
def q_outlook_big(spark, d):
    """Flagship at scale: the same outlook over every (supplier, ship day)."""
    return outlook(T.daily_big(spark, d))


# ---------------------------------------------------------------- FE-01..03

FE01_COLS = ["location_id", "date"] + FE01_SQL_FEATURES


@query("fe_01_env_features_general",
       "WITH " + fe01_sql("daily_big") + f"SELECT {', '.join(FE01_COLS)} FROM fe", ["daily_big"], bench=True)
def q_fe01(spark, d):
    """FE-01 over the supplier-day table (PRJ-17, MA-13/14, WN-01/04/05, FLT-04)."""
    return FE.env_features_general(T.daily_big(spark, d)).select(*FE01_COLS)


def _fe02_sql(src: str) -> str:
    cols = FE02_SQL_COLS
    wins = []
    for c in cols:
        wins += [f"lag({c}, 1) OVER w AS {c}_lag1", f"lag({c}, 2) OVER w AS {c}_lag2",
                 f"CASE WHEN count({c}) OVER w3 = 3 THEN avg({c}) OVER w3 END AS {c}_roll3",
                 f"CASE WHEN count({c}) OVER w7 = 7 THEN avg({c}) OVER w7 END AS {c}_roll7"]
    feats = cols + [f"{c}_{s}" for c in cols for s in ("lag1", "lag2", "roll3", "roll7")]
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in feats)
    return f"""
WITH f_a AS (
  SELECT * REPLACE (coalesce(pollen_tree, 0) AS pollen_tree, coalesce(pollen_grass, 0) AS pollen_grass,
                    coalesce(pollen_weed, 0) AS pollen_weed),
         temp_max - temp_min AS temp_range, PM2_5_max - PM2_5_mean AS pm_spike,
         humidity * (coalesce(PM2_5_mean, 0) + 1e-6) AS humid_x_pm, wind * (coalesce(PM2_5_mean, 0) + 1e-6) AS wind_x_pm,
         CAST(pollen_tree IS NULL AS INTEGER) AS pollen_tree_missing,
         CAST(pollen_grass IS NULL AS INTEGER) AS pollen_grass_missing,
         CAST(pollen_weed IS NULL AS INTEGER) AS pollen_weed_missing
  FROM {src}),
f_b AS (
  SELECT *, {', '.join(wins)} FROM f_a
  WINDOW w AS (PARTITION BY location_id ORDER BY date),
         w3 AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         w7 AS (PARTITION BY location_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT location_id, date, pollen_tree_missing, {', '.join(feats)} FROM f_b WHERE {notnull}"""


FE02_OUT = (["location_id", "date", "pollen_tree_missing"] + FE02_SQL_COLS
            + [f"{c}_{s}" for c in FE02_SQL_COLS for s in ("lag1", "lag2", "roll3", "roll7")])


@query("fe_02_env_features_flare", _fe02_sql("daily_big"), ["daily_big"])
def q_fe02(spark, d):
    """FE-02: 16 columns x lag1/lag2/roll3/roll7 in one window pass (WN-02, WN-06)."""
    return FE.env_features_flare(T.daily_big(spark, d)).select(*FE02_OUT)


FE03_SQL = """
WITH u AS (
  SELECT c.user_id, e.* EXCLUDE (location_id),
         e.temp_max - e.temp_min AS temp_swing,
         coalesce(e.pollen_tree, 0) + coalesce(e.pollen_grass, 0) + coalesce(e.pollen_weed, 0) AS pollen_total
  FROM (SELECT DISTINCT user_id, CAST(user_id % 10 + 10 * (user_id // 150) AS VARCHAR) AS location_id FROM checkins) c
  JOIN env_daily e ON e.location_id = c.location_id)
SELECT user_id, date,
  coalesce(PM2_5_mean - lag(PM2_5_mean) OVER w, 0) AS pm25_delta,
  coalesce(avg(PM2_5_mean) OVER p3, 0) AS pm25_roll3_mean,
  coalesce(avg(PM2_5_mean) OVER p7, 0) AS pm25_roll7_mean,
  CAST(coalesce(lag(PM2_5_mean) OVER w, 0) AS DOUBLE) AS pm25_lag1,
  coalesce(avg(AQI) OVER p3, 0) AS aqi_roll3_mean,
  coalesce(avg(AQI) OVER p7, 0) AS aqi_roll7_mean,
  CAST(coalesce(lag(AQI) OVER w, 0) AS DOUBLE) AS aqi_lag1,
  CAST(coalesce(lag(pollen_total) OVER w, 0) AS DOUBLE) AS pollen_total_lag1,
  PM2_5_mean * humidity AS pm25_x_humidity, pollen_total * wind AS pollen_x_wind, temp_swing
FROM u
WINDOW w AS (PARTITION BY user_id ORDER BY date),
       p3 AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       p7 AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""

FE03_OUT = ["user_id", "date", "pm25_delta", "pm25_roll3_mean", "pm25_roll7_mean", "pm25_lag1",
            "aqi_roll3_mean", "aqi_roll7_mean", "aqi_lag1", "pollen_total_lag1", "pm25_x_humidity",
            "pollen_x_wind", "temp_swing"]


def user_env(spark, d):
    """Each check-in user's environment history: env of the user's location."""
    users = (T.checkins(spark, d).select("user_id").distinct()
             .withColumn("location_id", T.location_of("user_id")))
    return users.join(T.env_daily(spark, d), "location_id", "inner").drop("location_id")


@query("fe_03_user_time_features", FE03_SQL, ["checkins", "env_daily"])
def q_fe03(spark, d):
    """FE-03: per-user env time features (WN-03/04/07, MA-13/14)."""
    return FE.user_time_features(user_env(spark, d), "user_id").select(*FE03_OUT)


# ---------------------------------------------------------------- windows

@query("wn_08_rolling_prev_single_series", """
SELECT date, coalesce(avg(PM2_5_mean) OVER p3, 0) AS pm25_roll3_mean,
       coalesce(avg(PM2_5_mean) OVER p7, 0) AS pm25_roll7_mean,
       coalesce(PM2_5_mean - lag(PM2_5_mean) OVER (ORDER BY date), 0) AS pm25_delta
FROM (SELECT date, avg(PM2_5_mean) AS PM2_5_mean FROM env_daily GROUP BY date)
WINDOW p3 AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       p7 AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", ["env_daily"])
def q_wn08(spark, d):
    """WN-08: the unpartitioned rolling form on one series: the daily mean over all locations (a row per
    calendar day, which bounds the one window)."""
    one = T.env_daily(spark, d).groupBy("date").agg(F.avg("PM2_5_mean").alias("PM2_5_mean"))
    w = W.series(None)
    return one.select("date", W.rolling_prev("PM2_5_mean", w, 3).alias("pm25_roll3_mean"),
                      W.rolling_prev("PM2_5_mean", w, 7).alias("pm25_roll7_mean"),
                      W.delta("PM2_5_mean", w, zero=True).alias("pm25_delta"))


@query("wn_10_flare_nextday", """
SELECT user_id, date, flare, flare_nextday FROM (
  SELECT user_id, date, CAST(symptomScore >= 4 AS INTEGER) AS flare,
         lead(CAST(symptomScore >= 4 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY date) AS flare_nextday
  FROM checkins) WHERE flare_nextday IS NOT NULL""", ["checkins"])
def q_wn10(spark, d):
    """WN-10: next-day label per user from today's label; last day dropped."""
    lab = T.checkins(spark, d).select("user_id", "date", L.severe("symptomScore").alias("flare"))
    return W.next_day_label(lab, "user_id", "flare", "flare_nextday")


@query("wn_11_ffill_bfill_trends", """
WITH spine AS (SELECT DISTINCT date FROM daily_big),
j AS (SELECT s.date, t.n_orders FROM spine s LEFT JOIN trends t ON s.date = t.date)
SELECT date, n_orders,
  coalesce(last_value(n_orders IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(n_orders IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend_filled
FROM j""", ["daily_big", "trends"])
def q_wn11(spark, d):
    """WN-11 (+JN-02): trends left-joined onto the env dates, forward then back filled."""
    spine = T.daily_big(spark, d).select("date").distinct()
    j = spine.join(T.trends(spark, d), "date", "left")
    # One row per calendar day: the window over dates is bounded by the calendar.
    return j.select("date", "n_orders", W.ffill_bfill("n_orders", W.series(None)).alias("trend_filled"))


@query("wn_12_first_per_date", """
SELECT user_id, date, wheeze, cough FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY symptomScore DESC, user_id) AS rn FROM checkins)
WHERE rn = 1""", ["checkins"])
def q_wn12(spark, d):
    """WN-12: first row per date after sorting (worst check-in of the day, ties by user)."""
    c = T.checkins(spark, d)
    return W.first_per(c, ["date"], [F.col("symptomScore").desc(), F.col("user_id")]) \
        .select("user_id", "date", "wheeze", "cough")


@query("wn_13_time_split", """
WITH f AS (SELECT location_id, date, row_number() OVER (ORDER BY date, location_id) - 1 AS row_idx,
                  count(*) OVER () AS n_rows FROM daily_big)
SELECT location_id, date, row_idx, n_rows,
       CASE WHEN row_idx < greatest(1, least(n_rows - 1, floor(n_rows * 0.8))) THEN 'train' ELSE 'test' END AS split
FROM f""", ["daily_big"], bench=True)
def q_wn13(spark, d):
    """WN-13: chronological 80/20 split by global row position (distributed prefix sums)."""
    df = T.daily_big(spark, d).select("location_id", "date")
    return W.time_split(df, 0.8, [F.col("date"), F.col("location_id")]) \
        .select("location_id", "date", "row_idx", "n_rows", "split")


@query("wn_13_time_split_test_ratio", """
WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () AS n_rows FROM scored)
SELECT doc_id, row_idx, CASE WHEN row_idx < n_rows - greatest(1, floor(n_rows * 0.2)) THEN 'train' ELSE 'test' END AS split
FROM f""", ["scored"])
def q_wn13b(spark, d):
    """WN-13 variant: the test set is the last max(1, int(n * 0.2)) rows."""
    df = T.scored(spark, d).select("doc_id")
    return W.time_split_test_size(df, 0.2, [F.col("doc_id")]).select("doc_id", "row_idx", "split")


@query("wn_14_expanding_folds", """
WITH f AS (SELECT location_id, date, row_number() OVER (ORDER BY date, location_id) - 1 AS row_idx,
                  count(*) OVER () AS n_rows FROM daily_big),
k AS (SELECT *, greatest(2, least(4, floor(n_rows / 20))) AS k FROM f),
t AS (SELECT *, floor(n_rows / (k + 1)) AS ts FROM k)
SELECT location_id, date, CAST(k AS BIGINT) AS n_folds, CAST(ts AS BIGINT) AS test_size,
       CAST(CASE WHEN ts > 0 AND row_idx >= n_rows - k * ts THEN floor((row_idx - (n_rows - k * ts)) / ts) + 1 END AS BIGINT) AS test_fold
FROM t""", ["daily_big"])
def q_wn14(spark, d):
    """WN-14: expanding-window folds, k = min(4, n // 20) (at least 2)."""
    df = T.daily_big(spark, d).select("location_id", "date")
    return W.expanding_folds(df, "main", [F.col("date"), F.col("location_id")]) \
        .select("location_id", "date", "n_folds", "test_size", "test_fold")


@query("wn_16_first_n_per_user", """
SELECT user_id, date, symptomScore FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS rn FROM checkins) WHERE rn <= 7""",
       ["checkins"])
def q_wn16(spark, d):
    """WN-16: first 7 days per user by date."""
    return W.first_n_per(T.checkins(spark, d), ["user_id"], [F.col("date")], 7) \
        .select("user_id", "date", "symptomScore")


@query("wn_17_fallback_levels", """
WITH l AS (SELECT DISTINCT location_id FROM env_daily),
d AS (SELECT location_id, unnest(generate_series(0, 13)) AS i FROM l)
SELECT location_id, CAST(DATE '2024-01-27' + CAST(i AS INTEGER) AS DATE) AS date,
       ([1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5])[i % 7 + 1]::DOUBLE AS score,
       (['low', 'low', 'moderate', 'moderate', 'moderate', 'high', 'high'])[i % 7 + 1] AS level,
       (['Low', 'Low', 'Moderate', 'Moderate', 'Moderate', 'High', 'High'])[i % 7 + 1] AS label,
       dayname(DATE '2024-01-27' + CAST(i AS INTEGER)) AS day_of_week,
       (['winter', 'spring', 'summer', 'fall'])[CAST(floor((month(DATE '2024-01-27' + CAST(i AS INTEGER)) % 12 + 3) / 3) AS INTEGER)] AS season
FROM d""", ["env_daily"])
def q_wn17(spark, d):
    """WN-17: static fallback week: day i of the window takes level i mod 7 (per location,
    rows generated by explode, no join), weekday and season from the date."""
    from airwise.functions import dates as D
    from airwise.operators import sets as ST
    s = F.lit("2024-01-27").cast("date")
    days = ST.expand_dates(T.env_daily(spark, d).select("location_id").distinct(), s, F.date_add(s, 13))
    lv = W.fallback_levels("day_idx")
    return days.select("location_id", "date", lv["score"].alias("score"), lv["level"].alias("level"),
                       lv["label"].alias("label"), D.weekday_name("date").alias("day_of_week"),
                       D.season_name(F.month("date")).alias("season"))


# ---------------------------------------------------------------- labels

@query("lb_01_high_risk_tomorrow",
       "WITH " + fe01_sql("env_daily") + "," + lb01_sql()
       + "SELECT location_id, date, AQI_tomorrow, PM2_5_mean_tomorrow, pollen_total_tomorrow, y FROM lb",
       ["env_daily"])
def q_lb01(spark, d):
    """LB-01 (+WN-09, FLT-11): label from tomorrow's values, last day dropped."""
    fe = FE.env_features_general(T.env_daily(spark, d))
    return L.high_risk_tomorrow(fe).select("location_id", "date", "AQI_tomorrow", "PM2_5_mean_tomorrow",
                                           "pollen_total_tomorrow", "y")


@query("lb_02_03_personal_labels", """
SELECT c.user_id, c.date,
  CAST(coalesce(c.symptomScore >= 4, false) OR coalesce(e.AQI > 100, false) OR coalesce(e.PM2_5_mean > 35, false)
       OR coalesce(coalesce(e.pollen_tree, 0) + coalesce(e.pollen_grass, 0) + coalesce(e.pollen_weed, 0) > 20, false) AS INTEGER) AS risk,
  CAST(coalesce(c.symptomScore >= 6, false) AS INTEGER) AS flare_day,
  CAST(coalesce(c.symptomScore >= 4, false) AS INTEGER) AS severe
FROM checkins c LEFT JOIN env_daily e ON e.location_id = CAST(c.user_id % 10 + 10 * (c.user_id // 150) AS VARCHAR) AND e.date = c.date""",
       ["checkins", "env_daily"])
def q_lb02(spark, d):
    """LB-02/LB-03: personal risk / flare_day / severe labels on check-ins joined to env."""
    c = T.checkins(spark, d).withColumn("location_id", T.location_of("user_id"))
    e = T.env_daily(spark, d)
    j = c.join(e.select("location_id", "date", "AQI", "PM2_5_mean", "pollen_tree", "pollen_grass", "pollen_weed"),
               ["location_id", "date"], "left")
    pol = M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed")
    return j.select("user_id", "date", L.personal_risk("symptomScore", "AQI", "PM2_5_mean", pol).alias("risk"),
                    L.flare_day("symptomScore").alias("flare_day"), L.severe("symptomScore").alias("severe"))


@query("lb_04_seed_rule", """
SELECT location_id, date, CAST(coalesce(AQI > 50, false) OR coalesce(PM2_5_mean > 15, false) AS INTEGER) AS flare
FROM daily_big""", ["daily_big"])
def q_lb04(spark, d):
    """LB-04: seed label rule AQI > 50 or PM > 15."""
    return T.daily_big(spark, d).select("location_id", "date", L.seed_rule("AQI", "PM2_5_mean").alias("flare"))


@query("lb_04_seeded_coin", """
SELECT location_id, date, CAST(CAST('0x' || substr(md5('42:' || location_id || '|' || CAST(date AS VARCHAR)), 1, 1) AS INTEGER) % 2 AS INTEGER) AS coin
FROM daily_big""", ["daily_big"])
def q_lb04b(spark, d):
    """LB-04, random variant: a seeded coin per (location, date)."""
    key = F.concat_ws("|", "location_id", F.col("date").cast("string"))
    return T.daily_big(spark, d).select("location_id", "date", L.seeded_coin(key).alias("coin"))


@query("lb_06_07_quantile_labels", """
WITH q AS (SELECT quantile_cont(n_orders, 0.8) AS thr,
                  quantile_cont(n_orders, [0.2, 0.4, 0.6, 0.8]) AS edges FROM trends)
SELECT date, n_orders, CAST(n_orders >= thr AS INTEGER) AS flare_day,
       CAST(1 + len(list_filter(edges, lambda e: e < n_orders)) AS INTEGER) AS risk
FROM trends, q""", ["trends"])
def q_lb0607(spark, d):
    """LB-06 (quantile threshold, AG-16) and LB-07 (1..5 quantile bins)."""
    t = T.trends(spark, d)
    thr = Q.quantile(t, "n_orders", 0.8)  # distributed exact quantile, one value
    out = t.withColumn("flare_day", L.flare_by_threshold("n_orders", thr))
    return L.quantile_bins(out, "n_orders", "risk").select("date", "n_orders", "flare_day", "risk")
