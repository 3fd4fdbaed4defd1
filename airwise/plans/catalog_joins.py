"""Queries: joins (JN-01 .. JN-18) and the personal enrichment pipeline (FE-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import mathx as M
from airwise.operators import aggregates as AG
from airwise.operators import joins as J
from airwise.operators import projections as P
from airwise.operators import sets as ST
from airwise.plans import features as FE
from airwise.plans.catalog_env import PROBA_SQL, fe01_sql, lb01_sql, outlook
from airwise.plans.registry import query
from airwise.sources import tables as T

FORECAST_DAYS = ["2024-01-24", "2024-01-25", "2024-01-26", "2024-01-27", "2024-01-28", "2024-01-29", "2024-01-30"]
FORECAST_SQL = ", ".join(f"DATE '{d}'" for d in FORECAST_DAYS)


def hourly(spark, d):
    """Readings shaped as hourly weather (temp = k, humidity = pm, ...)."""
    r = T.readings(spark, d)
    return r.select("location_id", "ts", "kind", F.col("k").cast("double").alias("temp"),
                    F.col("pm").alias("humidity"), (F.col("k") / 10.0).alias("wind"),
                    (100000 + F.col("k") * 10.0).alias("pressure"),
                    F.when(F.col("kind") == "error", F.col("pm") / 100).alias("rain"), "pm")


@query("jn_01_ag_01_02_weather_air_full_outer", """
WITH w AS (SELECT location_id, CAST(ts AS DATE) AS date, min(CAST(k AS DOUBLE)) AS temp_min, max(CAST(k AS DOUBLE)) AS temp_max,
                  avg(pm) AS humidity, avg(k / 10.0::DOUBLE) AS wind, avg(100000 + k * 10.0::DOUBLE) AS pressure,
                  coalesce(sum(CASE WHEN kind = 'error' THEN pm / 100 END), 0) AS rain
           FROM readings WHERE kind <> 'purchase' AND NOT (location_id = '3' AND day(ts) % 5 = 0)
           GROUP BY location_id, CAST(ts AS DATE)),
a AS (SELECT location_id, CAST(ts AS DATE) AS date, avg(pm) AS PM2_5_mean, max(pm) AS PM2_5_max
      FROM readings WHERE kind = 'purchase' GROUP BY location_id, CAST(ts AS DATE))
SELECT coalesce(w.location_id, a.location_id) AS location_id, coalesce(w.date, a.date) AS date,
       temp_min, temp_max, humidity, wind, pressure, rain, PM2_5_mean, PM2_5_max
FROM w FULL OUTER JOIN a ON w.location_id = a.location_id AND w.date = a.date""", ["readings"])
def q_jn01(spark, d):
    """JN-01 full outer join of AG-01 (hourly weather -> daily) and AG-02 (hourly PM -> daily)."""
    h = hourly(spark, d)
    w = AG.daily_weather(h.where((F.col("kind") != "purchase")
                                 & ~((F.col("location_id") == "3") & (F.dayofmonth("ts") % 5 == 0))))
    a = AG.daily_pm(h.where(F.col("kind") == "purchase"))
    return J.join_weather_air(w, a)


@query("jn_02_join_trends", """
SELECT e.location_id, e.date, e.PM2_5_mean, t.n_orders FROM daily_big e LEFT JOIN trends t ON e.date = t.date""",
       ["daily_big", "trends"])
def q_jn02(spark, d):
    """JN-02: env left join trends on date."""
    return J.join_trends(T.daily_big(spark, d).select("location_id", "date", "PM2_5_mean"), T.trends(spark, d))


@query("jn_03_load_merged", """
SELECT c.user_id, c.date, c.symptomScore, c.humidity, e.humidity AS humidity_env, e.AQI, e.PM2_5_mean
FROM (SELECT user_id, date, symptomScore, CAST(wheeze AS DOUBLE) AS humidity FROM checkins) c
LEFT JOIN (SELECT * FROM env_daily WHERE location_id = '3') e ON c.date = e.date""", ["checkins", "env_daily"])
def q_jn03(spark, d):
    """JN-03: check-ins left join env on date only, one location chosen; clashing names get _env."""
    c = T.checkins(spark, d).select("user_id", "date", "symptomScore", F.col("wheeze").cast("double").alias("humidity"))
    e = T.env_daily(spark, d).select("location_id", "date", "humidity", "AQI", "PM2_5_mean")
    return J.load_merged(c, e, location="3")


@query("jn_04_join_last_env", """
WITH last AS (SELECT date, arg_max_null(AQI, latitude) AS AQI, arg_max_null(location_id, latitude) AS env_location
              FROM env_daily GROUP BY date)
SELECT c.user_id, c.date, c.symptomScore, l.AQI, l.env_location FROM checkins c JOIN last l ON c.date = l.date""",
       ["checkins", "env_daily"])
def q_jn04(spark, d):
    """JN-04: inner lookup join where the last env row per date wins (ingest order = latitude)."""
    c = T.checkins(spark, d).select("user_id", "date", "symptomScore")
    e = T.env_daily(spark, d).select("date", "AQI", F.col("location_id").alias("env_location"),
                                     F.col("latitude").alias("ingestedAt"))
    return J.join_last_env(c, e).drop("ingestedAt")


FE04_SQL = f"""
WITH u AS (SELECT DISTINCT user_id FROM checkins),
ud AS (SELECT user_id, unnest([{FORECAST_SQL}]) AS date FROM u UNION SELECT user_id, date FROM checkins),
prof AS (SELECT user_id, profile_gender, profile_height FROM users),
j AS (SELECT ud.user_id, ud.date, p.profile_gender, p.profile_height,
             coalesce(c.wheeze, 0) AS wheeze, coalesce(c.cough, 0) AS cough,
             coalesce(c.chestTightness, 0) AS chestTightness, coalesce(c.exerciseMinutes, 0) AS exerciseMinutes
      FROM ud LEFT JOIN prof p ON ud.user_id = p.user_id
      LEFT JOIN checkins c ON c.user_id = ud.user_id AND c.date = ud.date)
SELECT * FROM (SELECT *, wheeze + cough + chestTightness AS symptom_score,
       coalesce(lag(wheeze) OVER w, 0) AS wheeze_lag1, coalesce(lag(cough) OVER w, 0) AS cough_lag1,
       coalesce(lag(chestTightness) OVER w, 0) AS chestTightness_lag1,
       coalesce(lag(exerciseMinutes) OVER w, 0) AS exerciseMinutes_lag1,
       coalesce(lag(wheeze + cough + chestTightness) OVER w, 0) AS symptom_score_lag1
FROM j WINDOW w AS (PARTITION BY user_id ORDER BY date)) WHERE date IN ({FORECAST_SQL})"""


def personal_enrichment(spark, d):
    """Users x forecast days.  Lags see the whole history: the window's rows are joined with all
    check-in days, lagged, and only then cut to the window."""
    days = T.checkins(spark, d).select("user_id", "date")
    window = J.users_x_dates(days.select("user_id").distinct(), FORECAST_DAYS)
    ud = window.select("user_id", "date").union(days).distinct()
    prof = P.widen_profile(T.users(spark, d), ["gender", "height"])
    j = J.join_checkins(J.join_profile(ud, prof), T.checkins(spark, d))
    return FE.symptom_lags(j).where(F.col("date").isin([F.lit(x).cast("date") for x in FORECAST_DAYS]))


@query("fe_04_jn_05_06_07_personal_enrichment", FE04_SQL, ["checkins", "users"])
def q_fe04(spark, d):
    """FE-04: users x forecast days (JN-05, explode), profile (JN-06), check-ins (JN-07), symptom lags (WN-03)."""
    return personal_enrichment(spark, d)


@query("jn_08_join_labels", """
WITH lab AS (SELECT user_id, CAST(user_id % 10 + 10 * (user_id // 150) AS VARCHAR) AS location_id, date, flare_nextday FROM (
  SELECT user_id, date, lead(CAST(symptomScore >= 4 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY date) AS flare_nextday
  FROM checkins) WHERE flare_nextday IS NOT NULL)
SELECT lab.user_id, e.date, e.AQI, e.PM2_5_mean, lab.flare_nextday
FROM env_daily e JOIN lab ON e.location_id = lab.location_id AND e.date = lab.date""", ["checkins", "env_daily"])
def q_jn08(spark, d):
    """JN-08 (+WN-10): env inner-joined to every user's next-day labels (env of the user's location)."""
    from airwise.operators import windows as W
    from airwise.functions import labels as L
    lab = T.checkins(spark, d).select("user_id", "date", L.severe("symptomScore").alias("flare"))
    lab = W.next_day_label(lab, "user_id", "flare", "flare_nextday") \
        .select("user_id", T.location_of("user_id").alias("location_id"), "date", "flare_nextday")
    e = T.env_daily(spark, d).select("location_id", "date", "AQI", "PM2_5_mean")
    return J.join_labels(e, lab, ["location_id", "date"]).select("user_id", "date", "AQI", "PM2_5_mean", "flare_nextday")


CACHE_SQL_BASE = f"""
cache AS (SELECT user_id, date, symptomScore AS risk FROM checkins WHERE user_id % 2 = 0),
wanted AS (SELECT user_id, unnest([{FORECAST_SQL}]) AS date FROM (SELECT DISTINCT user_id FROM checkins))"""


@query("jn_09_cache_misses", "WITH " + CACHE_SQL_BASE + """
SELECT user_id, date FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.user_id = w.user_id AND c.date = w.date)""", ["checkins"])
def q_jn09(spark, d):
    """JN-09: requested (user, date) pairs missing from the prediction cache (left anti)."""
    c = T.checkins(spark, d)
    cache = c.where(F.col("user_id") % 2 == 0).select("user_id", "date", F.col("symptomScore").alias("risk"))
    wanted = J.users_x_dates(c.select("user_id").distinct(), FORECAST_DAYS)
    return J.cache_misses(wanted, cache)


@query("jn_10_cached_rows", "WITH " + CACHE_SQL_BASE + f"""
SELECT user_id, date, risk FROM cache
WHERE user_id IN (SELECT user_id FROM checkins WHERE symptomScore >= 6) AND date IN ({FORECAST_SQL})""", ["checkins"])
def q_jn10(spark, d):
    """JN-10: cached rows of the requested users and dates (two left-semi joins)."""
    c = T.checkins(spark, d)
    cache = c.where(F.col("user_id") % 2 == 0).select("user_id", "date", F.col("symptomScore").alias("risk"))
    users = c.where(F.col("symptomScore") >= 6).select("user_id").distinct()  # users asking for a forecast
    dates = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("date") for x in FORECAST_DAYS])).alias("date"))
    return J.cached_rows(cache, users, dates)


@query("jn_11_ag_17_override_scores", """
WITH pred AS (SELECT user_id, date, sround(greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1 + 4 * (symptomScore / 9))), 2) AS score
              FROM checkins),
ns AS (SELECT user_id, bool_and(coalesce(wheeze, 0) = 0 AND coalesce(cough, 0) = 0 AND coalesce(chestTightness, 0) = 0) AS no_symptoms
       FROM checkins WHERE date < DATE '2024-01-10' GROUP BY user_id),
env AS (SELECT location_id, date, CAST(1 + 4 * (AQI / 200) AS DOUBLE) AS score FROM env_daily)
SELECT p.user_id, p.date,
       CASE WHEN coalesce(ns.no_symptoms, false) AND env.score IS NOT NULL THEN env.score ELSE p.score END AS score
FROM pred p LEFT JOIN ns ON p.user_id = ns.user_id
LEFT JOIN env ON env.location_id = CAST(p.user_id % 10 + 10 * (p.user_id // 150) AS VARCHAR) AND p.date = env.date""", ["checkins", "env_daily"])
def q_jn11(spark, d):
    """JN-11 + AG-17 + MA-05: users with no symptoms take the env-only score of the date."""
    c = T.checkins(spark, d)
    pred = c.select("user_id", T.location_of("user_id").alias("location_id"), "date",
                    M.binary_score(F.col("symptomScore") / 9).alias("score"))
    ns = AG.users_without_symptoms(c.where(F.col("date") < "2024-01-10"))
    env = T.env_daily(spark, d).select("location_id", "date", (1 + 4 * (F.col("AQI") / 200)).alias("score"))
    return J.override_scores(pred, ns, env, keys=["location_id", "date"]).select("user_id", "date", "score")


@query("jn_12_match_or_last", f"""
WITH locs AS (SELECT DISTINCT location_id FROM env_daily),
wanted AS (SELECT location_id, CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date FROM locs),
last AS (SELECT location_id, arg_max_null(AQI, date) AS AQI, arg_max_null(PM2_5_mean, date) AS PM2_5_mean FROM env_daily GROUP BY location_id)
SELECT w.location_id, w.date, e.location_id IS NOT NULL AS exact_match,
       CASE WHEN e.location_id IS NOT NULL THEN e.AQI ELSE l.AQI END AS AQI,
       CASE WHEN e.location_id IS NOT NULL THEN e.PM2_5_mean ELSE l.PM2_5_mean END AS PM2_5_mean
FROM wanted w LEFT JOIN env_daily e ON e.location_id = w.location_id AND e.date = w.date
LEFT JOIN last l ON l.location_id = w.location_id""", ["env_daily"])
def q_jn12(spark, d):
    """JN-12: exact date match, else the last row of the location (as-of fallback)."""
    env = T.env_daily(spark, d).select("location_id", "date", "AQI", "PM2_5_mean")
    wanted = ST.expand_dates(env.select("location_id").distinct(), F.lit("2024-01-27").cast("date"),
                             F.lit("2024-02-02").cast("date")).drop("day_idx")
    return J.match_or_last(wanted, env)


@query("jn_13_match_or_synthetic", f"""
WITH locs AS (SELECT DISTINCT location_id FROM env_daily),
wanted AS (SELECT location_id, CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date FROM locs),
s AS (SELECT location_id, date, ((date_diff('day', DATE '0001-01-01', date) + 1) % 7) / 7.0::DOUBLE AS j FROM wanted)
SELECT w.location_id, w.date, e.location_id IS NOT NULL AS from_store,
       CASE WHEN e.location_id IS NOT NULL THEN e.AQI ELSE CAST(40 + floor(30 * s.j) AS DOUBLE) END AS AQI,
       CASE WHEN e.location_id IS NOT NULL THEN e.humidity ELSE 55.0 + 20 * s.j END AS humidity
FROM wanted w LEFT JOIN env_daily e ON e.location_id = w.location_id AND e.date = w.date
LEFT JOIN s ON s.location_id = w.location_id AND s.date = w.date""", ["env_daily"])
def q_jn13(spark, d):
    """JN-13 (+ST-04): exact date match, else the generated row for that date."""
    env = T.env_daily(spark, d).select("location_id", "date", "AQI", "humidity")
    wanted = ST.expand_dates(env.select("location_id").distinct(), F.lit("2024-01-27").cast("date"),
                             F.lit("2024-02-02").cast("date")).drop("day_idx")
    synth = ST.synthetic_env(wanted, "risk").select("location_id", "date", "AQI", "humidity")
    return J.match_or_synthetic(wanted, env, synth)


def alert_list(spark, d):
    risk = outlook(T.env_daily(spark, d)).select("location_id", "date", "level", "score")
    users = T.users(spark, d).select("user_id", "email", "name", "location")
    return J.alerts(users, risk, "2024-01-27", "0")


@query("jn_14_alerts", f"""
WITH {fe01_sql('env_daily')},
{lb01_sql()},
risk AS (SELECT location_id, date,
   CASE WHEN {PROBA_SQL} < 0.2 THEN 'low'
        WHEN {PROBA_SQL} < 0.5 THEN 'moderate' ELSE 'high' END AS level
   FROM lb WHERE date = DATE '2024-01-27')
SELECT u.user_id, u.email, coalesce(nullif(wtrim(u.location), ''), '0') AS alert_location, r.level,
       r.level = 'high' AND coalesce(length(wtrim(u.email)) > 0, false) AS sent,
       coalesce(nullif(wtrim(u.name), ''), 'there') AS greeting
FROM users u JOIN risk r ON r.location_id = coalesce(nullif(wtrim(u.location), ''), '0')""", ["env_daily", "users"])
def q_jn14(spark, d):
    """JN-14 (+FLT-06/09, STR-13): users x tomorrow's risk of their location; who gets an alert."""
    from airwise.functions import strings as S
    a = alert_list(spark, d)
    sent = (F.col("level") == "high") & F.coalesce(F.length(S.ws_trim("email")) > 0, F.lit(False))
    return a.select("user_id", "email", "alert_location", "level",
                    sent.alias("sent"),
                    S.display_name("name").alias("greeting"))


@query("jn_15_near_sensors", """
WITH pts AS (SELECT DISTINCT location_id, latitude, longitude FROM daily_big),
sen AS (SELECT c_custkey, 24 + c_custkey % 27 + (c_custkey % 10) / 10.0::DOUBLE AS s_lat,
               -125 + c_custkey % 59 + (c_custkey % 7) / 10.0::DOUBLE AS s_lon FROM customer)
SELECT p.location_id, s.c_custkey FROM pts p JOIN sen s
ON s.s_lat BETWEEN p.latitude - 60.0::DOUBLE / 111.0 AND p.latitude + 60.0::DOUBLE / 111.0
AND s.s_lon BETWEEN p.longitude - 60.0::DOUBLE / (111.0 * greatest(cos(radians(p.latitude)), 0.01))
                AND p.longitude + 60.0::DOUBLE / (111.0 * greatest(cos(radians(p.latitude)), 0.01))""",
       ["daily_big"])
def q_jn15(spark, d):
    """JN-15 (+FLT-08): sensors within 60 km boxes of each location (grid equi-join + residual)."""
    pts = T.daily_big(spark, d).select("location_id", "latitude", "longitude").distinct()
    c = T.raw(spark, d, "customer")
    k = F.col("c_custkey")
    sen = c.select("c_custkey", (24 + k % 27 + (k % 10) / 10.0).alias("s_lat"),
                   (-125 + k % 59 + (k % 7) / 10.0).alias("s_lon"))
    return J.near_pairs(pts, sen, 60.0).select("location_id", "c_custkey")


@query("jn_16_ma_16_pollen_calendar", """
WITH cal(month, tree_index, grass_index, weed_index) AS (VALUES
  (1, 4, 0, 0), (2, 4, 0, 0), (3, 4, 1, 0), (4, 4, 2, 0), (5, 3, 4, 0), (6, 2, 4, 1),
  (7, 2, 3, 2), (8, 2, 2, 3), (9, 2, 1, 4), (10, 1, 0, 4), (11, 1, 0, 2), (12, 3, 0, 0)),
k AS (SELECT location_id, date,
        CASE WHEN latitude BETWEEN 24 AND 50 AND longitude BETWEEN -125 AND -66
             THEN CASE WHEN latitude < 37 THEN 'US_South' ELSE 'US' END END AS region
      FROM daily_big)
SELECT k.location_id, k.date, k.region, CAST(c.tree_index AS DOUBLE) AS tree_index,
       CAST(c.grass_index AS DOUBLE) AS grass_index, CAST(c.weed_index AS DOUBLE) AS weed_index
FROM k LEFT JOIN cal c ON k.region IS NOT NULL AND c.month = month(k.date)""", ["daily_big"])
def q_jn16(spark, d):
    """JN-16 + MA-16: region from coordinates, calendar pollen by (region, month)."""
    df = T.daily_big(spark, d).select("location_id", "date", "latitude", "longitude")
    return J.join_pollen_calendar(df).select("location_id", "date", "region", "tree_index", "grass_index",
                                             "weed_index")


@query("jn_17_ma_15_prev_day_trend", """
WITH a AS (SELECT location_id, date, CAST(max(k) AS DOUBLE) AS aqi_max, avg(k) AS aqi_mean FROM readings GROUP BY location_id, date)
SELECT t.location_id, t.date, t.aqi_max, y.aqi_mean AS aqi_mean_prev,
       CASE WHEN y.aqi_mean IS NULL THEN NULL WHEN t.aqi_max > y.aqi_mean THEN 'up'
            WHEN t.aqi_max < y.aqi_mean THEN 'down' ELSE 'stable' END AS aqi_24h_trend
FROM a t LEFT JOIN a y ON y.location_id = t.location_id AND y.date + 1 = t.date""", ["readings"])
def q_jn17(spark, d):
    """JN-17 + MA-15: previous-calendar-day self join and the 24 h AQI trend."""
    a = T.readings(spark, d).groupBy("location_id", "date").agg(F.max("k").cast("double").alias("aqi_max"),
                                                                 F.avg("k").alias("aqi_mean"))
    j = J.prev_day(a, cols=["aqi_mean"])
    return j.select("location_id", "date", "aqi_max", F.col("aqi_mean_prev"),
                    M.aqi_trend("aqi_max", "aqi_mean_prev").alias("aqi_24h_trend"))


@query("jn_18_assemble_records", """
SELECT location_id, date, PM2_5_mean AS aq_pm25,
       CASE WHEN location_id = '0' THEN NULL ELSE temp_min END AS wx_temp_min,
       CASE WHEN location_id IN ('0') THEN 'missing coordinates' END AS wx_error,
       CASE WHEN location_id IN ('0') THEN 'missing coordinates' END AS pollen_error,
       dayname(date) AS day_of_week
FROM env_daily""", ["env_daily"])
def q_jn18(spark, d):
    """JN-18: one nested record per (location, date) from four domain tables; error struct without coordinates."""
    e = T.env_daily(spark, d)
    no_coord = F.col("location_id") == "0"
    ctx = e.select("location_id", "date", F.when(no_coord, F.lit(None).cast("double")).otherwise(F.col("latitude")).alias("latitude"),
                   "longitude", "day_of_week")
    aq = e.select("location_id", "date", F.col("PM2_5_mean").alias("pm25_mean"))
    wx = e.where(~no_coord).select("location_id", "date", F.col("temp_min").alias("temp_min_c"),
                                   F.lit(None).cast("string").alias("error"))
    po = e.select("location_id", "date", F.col("pollen_tree").alias("tree_index"), F.lit(None).cast("string").alias("error"))
    rec = J.assemble(aq, wx, po, ctx)
    return rec.select("location_id", "date", F.col("air_quality.pm25_mean").alias("aq_pm25"),
                      F.col("weather.temp_min_c").alias("wx_temp_min"), F.col("weather.error").alias("wx_error"),
                      F.col("pollen.error").alias("pollen_error"), F.col("time_context.day_of_week").alias("day_of_week"))
