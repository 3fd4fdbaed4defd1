"""Queries: scans, projections, filters, sorts, set ops / generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import mathx as M
from airwise.functions import strings as S
from airwise.operators import filters as FL
from airwise.operators import projections as P
from airwise.operators import sets as ST
from airwise.operators import sorts as SL
from airwise.plans.catalog_env import PROBA_SQL, fe01_sql, lb01_sql, outlook
from airwise.plans.registry import query
from airwise.plans.sqlviews import holiday_sql, season_sql
from airwise.sources import scans as SC
from airwise.sources import tables as T

# ---------------------------------------------------------------- scans

@query("src_01_02_env_scan_location_range", """
SELECT * FROM daily_big WHERE location_id = '7' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
       ["daily_big"])
def q_src01(spark, d):
    """SRC-01 + SRC-02 + FLT-01: location equality and an inclusive date range (pushed down)."""
    return SC.read_env_range(FL.where_eq(T.daily_big(spark, d), "location_id", "7"), "1996-01-01", "1996-12-31")


@query("src_02_last_days", """
SELECT location_id, date, PM2_5_mean FROM env_daily WHERE date BETWEEN DATE '2024-01-14' AND DATE '2024-01-20'""",
       ["env_daily"])
def q_src02(spark, d):
    """SRC-02 'last N days' variant: the 7 days ending at the as-of date."""
    return SC.read_env_last_days(T.env_daily(spark, d), "2024-01-20", 7).select("location_id", "date", "PM2_5_mean")


@query("src_03_prj_06_users_profile", """
SELECT user_id, profile_name, profile_height, profile_weight, profile_gender, profile_smokerStatus, profile_petExposure
FROM users""", ["users"])
def q_src03(spark, d):
    """SRC-03 + PRJ-06: users scan projected to profile fields, widened to profile_* columns."""
    return P.widen_profile(T.users(spark, d))


@query("src_01_read_daily_env", """
SELECT location_id, date, PM2_5_mean, AQI FROM daily_big WHERE location_id = '7'""", ["daily_big"])
def q_src01b(spark, d):
    """SRC-01: the daily table written, then read by the operator with its location filter; a location
    without rows is an error."""
    from airwise.operators import sinks as SK
    path = SK.scratch_path(spark, "daily-env")
    T.daily_big(spark, d).select("location_id", "date", "PM2_5_mean", "AQI").write.parquet(path)
    try:
        SC.read_daily_env(spark, path, "no such place")
        raise AssertionError("an empty read must be an error")
    except SC.EmptySourceError:
        return SC.read_daily_env(spark, path, "7")


@query("src_03_read_users", """
SELECT u.user_id, u.profile_name AS name, (SELECT CAST(count(*) AS INTEGER) FROM checkins c WHERE c.user_id = u.user_id) AS n_checkins
FROM users u""", ["users", "checkins"])
def q_src03b(spark, d):
    """SRC-03: nested users written, then read by the operator: profile and checkIns only."""
    from airwise.operators import sinks as SK
    path = SK.scratch_path(spark, "users")
    nested = SK.nest_checkins(T.users(spark, d).select("user_id", "email", "profile"), T.checkins(spark, d))
    nested.withColumnRenamed("user_id", "_id").write.parquet(path)
    u = SC.read_users(spark, path)
    return u.select("user_id", F.col("profile.name").alias("name"), F.coalesce(F.array_size("checkIns"), F.lit(0)).alias("n_checkins"))


# ---------------------------------------------------------------- projections

FLAT_SQL = f"""
SELECT strftime(date, '%Y-%m-%d') AS date, printf('%.4f_%.4f', latitude, longitude) AS locationKey,
       PM2_5_mean AS pm25_mean, PM2_5_max AS pm25_max, CAST(trunc(AQI) AS INTEGER) AS aqi,
       CAST(NULL AS VARCHAR) AS aqi_24h_trend,
       temp_min AS temp_min_c, temp_max AS temp_max_c, humidity AS humidity_mean, humidity AS humidity_max,
       wind AS wind_speed_kmh, pressure AS pressure_pa, rain AS rain_mm,
       CASE WHEN pollen_tree IS NOT NULL OR pollen_grass IS NOT NULL THEN pollen_tree END AS tree_index,
       CASE WHEN pollen_tree IS NOT NULL OR pollen_grass IS NOT NULL THEN pollen_grass END AS grass_index,
       CASE WHEN pollen_tree IS NOT NULL OR pollen_grass IS NOT NULL THEN pollen_weed END AS weed_index,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week_num, {season_sql('month(date)', 'autumn')} AS season,
       {holiday_sql('date')} AS is_holiday
FROM daily_big"""


@query("prj_01_flatten_env", FLAT_SQL, ["daily_big"])
def q_prj01(spark, d):
    """PRJ-01 (+DT-06, STR-01): nested env documents flattened to 2 keys + 17 values."""
    return P.flatten_env(P.nest_env(T.daily_big(spark, d)))


@query("prj_02_to_daily_row", """
SELECT CASE WHEN zip_code IS NOT NULL AND zip_code <> '' THEN 'zip_' || zip_code
            ELSE CAST(sround(latitude, 4) AS VARCHAR) || '_' || CAST(sround(longitude, 4) AS VARCHAR) END AS location_id,
       date, PM2_5_mean, CAST(CAST(trunc(AQI) AS INTEGER) AS DOUBLE) AS AQI, temp_min,
       CASE WHEN pollen_tree IS NOT NULL OR pollen_grass IS NOT NULL THEN pollen_weed END AS pollen_weed, month, holiday_flag
FROM daily_big""", ["daily_big"])
def q_prj02(spark, d):
    """PRJ-02 (+STR-02): pulled nested rows mapped back to canonical daily rows."""
    out = P.to_daily_row(P.nest_env(T.daily_big(spark, d)))
    return out.select("location_id", "date", "PM2_5_mean", "AQI", "temp_min", "pollen_weed", "month", "holiday_flag")


@query("prj_03_to_week_row", f"""
SELECT replace(replace(location_id, '_', ''), ' ', '') AS locationid, strftime(date, '%Y-%m-%d') AS date,
       PM2_5_mean, AQI, dayname(date) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
       {season_sql('month(date)')} AS season, holiday_flag
FROM env_daily""", ["env_daily"])
def q_prj03(spark, d):
    """PRJ-03 (+STR-03): daily rows in the weekly/flare layout."""
    return P.to_week_row(T.env_daily(spark, d)).select("locationid", "date", "PM2_5_mean", "AQI", "day_of_week",
                                                       "month", "season", "holiday_flag")


@query("prj_04_05_fill_defaults", """
SELECT location_id, date, coalesce(pollen_tree, 0) AS pollen_tree, coalesce(pollen_grass, 0) AS pollen_grass,
       coalesce(pollen_weed, 0) AS pollen_weed, coalesce(AQI, 50) AS AQI, day_of_week, month, season
FROM daily_big""", ["daily_big"])
def q_prj05(spark, d):
    """PRJ-05: per-column null defaults; weekday/month/season from the date when missing (PRJ-04 drops raw)."""
    df = T.daily_big(spark, d).withColumn("raw", F.lit("payload"))
    df = P.strip_raw(df)
    df = df.withColumn("day_of_week", F.lit(None).cast("string")).withColumn("month", F.lit(None).cast("int"))
    return P.fill_daily_defaults(df).select("location_id", "date", "pollen_tree", "pollen_grass", "pollen_weed",
                                            "AQI", "day_of_week", "month", "season")


@query("prj_07_coerce_checkins", """
SELECT user_id, date, coalesce(TRY_CAST(CASE WHEN wheeze > 0 THEN CAST(wheeze AS VARCHAR) ELSE 'n/a' END AS DOUBLE), 0) AS wheeze,
       CAST(cough AS DOUBLE) AS cough, CAST(chestTightness AS DOUBLE) AS chestTightness, CAST(0 AS DOUBLE) AS exerciseMinutes
FROM checkins""", ["checkins"])
def q_prj07(spark, d):
    """PRJ-07: text symptoms to numbers (bad -> 0), an absent column -> 0."""
    c = T.checkins(spark, d)
    c = c.select("user_id", "date",
                 F.when(F.col("wheeze") > 0, F.col("wheeze").cast("string")).otherwise("n/a").alias("wheeze"),
                 "cough", "chestTightness")
    return P.coerce_checkins(c)


@query("prj_08_checkin_rows", """
SELECT coalesce(CASE WHEN day(date) % 2 = 0 THEN strftime(date, '%Y-%m-%d') END,
                strftime(CAST(date AS TIMESTAMP) + INTERVAL 8 HOUR, '%Y-%m-%d')) AS date,
       CAST(user_id AS VARCHAR) AS userId, rescueUsed, symptomScore
FROM checkins""", ["checkins"])
def q_prj08(spark, d):
    """PRJ-08: older check-in layout -> rows keyed by date text (updatedAt when no date)."""
    c = T.checkins(spark, d)
    old = c.select(F.col("user_id").cast("string").alias("userId"),
                   F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "yyyy-MM-dd")).alias("date"),
                   (F.col("date").cast("timestamp") + F.expr("INTERVAL 8 HOURS")).alias("updatedAt"),
                   "rescueUsed", "symptomScore")
    return P.checkin_rows(old)


@query("prj_09_12_order_and_rename", """
SELECT date, n_orders AS google_trends_air_quality, 'allergy' AS keyword FROM trends""", ["trends"])
def q_prj09(spark, d):
    """PRJ-09 (known columns first, constants added) + PRJ-12 (dynamic trends column name)."""
    t = T.trends(spark, d).withColumnRenamed("n_orders", "trend")
    t = P.rename_trend(t, "air quality")
    return P.order_columns(t, ["date", "zip_code"], {"keyword": "allergy"})


@query("prj_10_align_features", """
SELECT location_id, CAST(coalesce(PM2_5_mean, 0) AS DOUBLE) AS PM2_5_mean, CAST(0 AS DOUBLE) AS google_trends_allergy,
       CAST(holiday_flag AS DOUBLE) AS holiday_flag, coalesce(pollen_tree, 0) AS pollen_tree,
       CAST(coalesce(TRY_CAST(season AS DOUBLE), 0) AS DOUBLE) AS season
FROM daily_big""", ["daily_big"])
def q_prj10(spark, d):
    """PRJ-10: align to a saved feature list (missing -> 0, text coerced, null -> 0, order kept)."""
    feats = ["PM2_5_mean", "google_trends_allergy", "holiday_flag", "pollen_tree", "season"]
    return P.align_features(T.daily_big(spark, d), feats, keep=["location_id"])


@query("prj_11_normalize_columns", """
SELECT locationid AS location_id, aqi AS AQI, temp_min_c AS temp_min, false AS holiday_flag,
       CAST(50 AS DOUBLE) AS google_trends_allergy
FROM (SELECT location_id AS locationid, AQI AS aqi, temp_min AS temp_min_c FROM daily_big)""", ["daily_big"])
def q_prj11(spark, d):
    """PRJ-11: alias spellings renamed to canonical names, defaults added."""
    df = T.daily_big(spark, d).select(F.col("location_id").alias("locationid"), F.col("AQI").alias("aqi"),
                                      F.col("temp_min").alias("temp_min_c"))
    return P.normalize_columns(df, "google_trends_allergy")


@query("prj_13_14_risk_records", f"""
SELECT location_id, strftime(date, '%Y-%m-%d') AS rec_date,
       sround(CASE WHEN p < 0.2 THEN 1 + p * 5 WHEN p < 0.5 THEN 2 + (p - 0.2::DOUBLE) * 10 ELSE 4 + (p - 0.5::DOUBLE) * 2 END, 1) AS score,
       CASE WHEN p < 0.2 THEN 'Low' WHEN p < 0.5 THEN 'Moderate' ELSE 'High' END AS label,
       dayname(date) AS daily_dow,
       (['winter', 'spring', 'summer', 'fall'])[CAST(floor((month(date) % 12 + 3) / 3) - 1 AS INTEGER) % 4 + 1] AS daily_season
FROM (SELECT *, {PROBA_SQL.replace('pollen_total', '(coalesce(pollen_tree, 0) + coalesce(pollen_grass, 0) + coalesce(pollen_weed, 0))')} AS p
      FROM env_daily)""", ["env_daily"])
def q_prj13(spark, d):
    """PRJ-13 (daily struct with index->name) + PRJ-14 (nested response record)."""
    e = T.env_daily(spark, d).withColumn("day_of_week", F.lit(None).cast("string")) \
        .withColumn("season", F.lit(None).cast("string"))
    p = M.rule_probability("AQI", "PM2_5_mean", M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed"))
    from airwise.functions import arrays as A
    rec = P.risk_record(F.date_format("date", "yyyy-MM-dd"), p,
                        A.risk_factors("AQI", "PM2_5_mean", F.lit(0.0)), P.daily_doc(e))
    out = e.select("location_id", rec.alias("r"))
    return out.select("location_id", F.col("r.date").alias("rec_date"), F.col("r.risk.score").alias("score"),
                      F.col("r.risk.label").alias("label"), F.col("r.daily.day_of_week").alias("daily_dow"),
                      F.col("r.daily.season").alias("daily_season"))


@query("prj_16_fill_median", """
WITH m AS (SELECT quantile_cont(pollen_tree, 0.5) AS mt, quantile_cont(pollen_weed, 0.5) AS mw FROM daily_big)
SELECT location_id, date, coalesce(pollen_tree, coalesce(m.mt, 0)) AS pollen_tree,
       coalesce(pollen_weed, coalesce(m.mw, 0)) AS pollen_weed
FROM daily_big, m""", ["daily_big"])
def q_prj16(spark, d):
    """PRJ-16: numeric nulls filled with the exact column median (0 if all null)."""
    df = T.daily_big(spark, d).select("location_id", "date", "pollen_tree", "pollen_weed")
    return P.fill_median(df, ["pollen_tree", "pollen_weed"])


@query("prj_18_pick_score", """
SELECT user_id, date, CAST(coalesce(CASE WHEN wheeze > 1 THEN wheeze END, CASE WHEN cough > 1 THEN cough END, 0) AS DOUBLE) AS score
FROM checkins""", ["checkins"])
def q_prj18(spark, d):
    """PRJ-18: score column by target: risk, else flare_day, else 0."""
    c = T.checkins(spark, d).select("user_id", "date",
                                    F.when(F.col("wheeze") > 1, F.col("wheeze")).alias("risk"),
                                    F.when(F.col("cough") > 1, F.col("cough")).alias("flare_day"))
    return c.select("user_id", "date", P.pick_score(c).alias("score"))


# ---------------------------------------------------------------- filters

@query("flt_02_filter_dates", """
SELECT location_id, date FROM env_daily WHERE date IN (DATE '2024-01-03', DATE '2024-01-10', DATE '2024-01-17')
UNION ALL
SELECT location_id, date FROM daily_big WHERE date IN (SELECT date FROM trends WHERE n_orders >= 12)""",
       ["env_daily", "daily_big", "trends"])
def q_flt02(spark, d):
    """FLT-02: date membership, as a literal ``isin`` and as a left-semi join on a date table."""
    a = FL.filter_dates(T.env_daily(spark, d), ["2024-01-03", "2024-01-10", "2024-01-17"]).select("location_id", "date")
    busy = T.trends(spark, d).where(F.col("n_orders") >= 12).select("date")
    b = FL.filter_dates(T.daily_big(spark, d).select("location_id", "date"), busy)
    return a.unionByName(b)


@query("flt_03_keep_first_location", """
SELECT location_id, date FROM daily_big
WHERE location_id = (SELECT location_id FROM daily_big ORDER BY date, location_id LIMIT 1)""", ["daily_big"])
def q_flt03(spark, d):
    """FLT-03: keep the location of the earliest row (min_by, scalar subquery)."""
    return FL.keep_first_location(T.daily_big(spark, d)).select("location_id", "date")


@query("flt_04_drop_incomplete", """
SELECT location_id, date, pollen_tree, pollen_weed FROM daily_big
WHERE pollen_tree IS NOT NULL AND pollen_weed IS NOT NULL""", ["daily_big"])
def q_flt04(spark, d):
    """FLT-04: drop rows with a null in the subset."""
    df = T.daily_big(spark, d).select("location_id", "date", "pollen_tree", "pollen_weed")
    return FL.drop_incomplete(df, ["pollen_tree", "pollen_weed"])


@query("flt_06_with_email", """
SELECT user_id, email FROM users WHERE length(wtrim(email)) > 0""", ["users"])
def q_flt06(spark, d):
    """FLT-06: users with a non-empty e-mail."""
    return FL.with_email(T.users(spark, d).select("user_id", "email"))


@query("flt_07_12_text_predicates", """
SELECT date, n_orders,
       coalesce(regexp_matches(CASE WHEN n_orders % 3 = 0 THEN strftime(date, '%Y-%m-%d') ELSE strftime(date, '%d/%m/%Y') END,
                               '^\\d{4}-\\d{2}-\\d{2}$'), false) AS iso_ok,
       (['low', 'moderate', 'high', 'extreme'])[n_orders % 4 + 1] IN ('low', 'moderate', 'high') AS level_ok
FROM trends""", ["trends"])
def q_flt07(spark, d):
    """FLT-07 (ISO date text) and FLT-12 (risk-level enumeration) predicates."""
    from airwise.operators import windows as W
    t = T.trends(spark, d)
    txt = F.when(F.col("n_orders") % 3 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    lvl = W.cycle_pick(["low", "moderate", "high", "extreme"], F.col("n_orders"))
    return t.select("date", "n_orders", S.is_iso_date(txt).alias("iso_ok"), FL.is_risk_level(lvl).alias("level_ok"))


@query("flt_08_bbox", """
SELECT location_id, date FROM daily_big
WHERE latitude BETWEEN 28.0 - 350.0 / 111.0 AND 28.0 + 350.0 / 111.0
  AND longitude BETWEEN -121.0 - 350.0 / (111.0 * greatest(cos(radians(28.0)), 0.01))
                    AND -121.0 + 350.0 / (111.0 * greatest(cos(radians(28.0)), 0.01))""", ["daily_big"])
def q_flt08(spark, d):
    """FLT-08: rows inside the bounding box of 350 km around (28, -121)."""
    df = T.daily_big(spark, d)
    return df.where(FL.in_bbox("latitude", "longitude", 28.0, -121.0, 350.0)).select("location_id", "date")


@query("flt_09_high_risk_only", "WITH " + fe01_sql("env_daily") + "," + lb01_sql() + f"""
SELECT location_id, date FROM lb
WHERE CASE WHEN {PROBA_SQL} < 0.2 THEN 'low' WHEN {PROBA_SQL} < 0.5 THEN 'moderate' ELSE 'high' END = 'high'""",
       ["env_daily"])
def q_flt09(spark, d):
    """FLT-09: high-risk rows of the outlook only."""
    return outlook(T.env_daily(spark, d)).where(F.col("level") == "high").select("location_id", "date")


@query("flt_10_trainable_stats", """
SELECT count(*) AS n_rows, count(DISTINCT CAST(symptomScore >= 4 AS INTEGER)) AS n_classes,
       count(DISTINCT user_id) AS n_users FROM checkins""", ["checkins"])
def q_flt10(spark, d):
    """FLT-10: the guard table (rows, classes, users) checked before training."""
    c = T.checkins(spark, d).withColumn("severe", (F.col("symptomScore") >= 4).cast("int"))
    return FL.trainable_stats(c, "severe", "user_id")


@query("flt_11_drop_last_day", """
SELECT location_id, date FROM (SELECT location_id, date, lead(date) OVER (PARTITION BY location_id ORDER BY date) AS nx
FROM daily_big) WHERE nx IS NOT NULL""", ["daily_big"])
def q_flt11(spark, d):
    """FLT-11: drop the last day of each series (it has no future value)."""
    return FL.drop_last_day(T.daily_big(spark, d).select("location_id", "date"))


# ---------------------------------------------------------------- sorts

@query("sl_01_02_top_days", "WITH " + fe01_sql("daily_big") + "," + lb01_sql() + f"""
SELECT location_id, date, {PROBA_SQL} AS proba FROM lb ORDER BY proba DESC, location_id, date LIMIT 10""",
       ["daily_big"])
def q_sl02(spark, d):
    """SL-01/SL-02: top 10 location-days by predicted risk (TakeOrderedAndProject)."""
    o = outlook(T.daily_big(spark, d))
    return SL.top_k(o.select("location_id", "date", "proba"),
                    [F.col("proba").desc(), F.col("location_id"), F.col("date")], 10)


@query("sl_03_precision_at_k", """
WITH r AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM scored)
SELECT avg(CAST(y AS DOUBLE)) AS precision_at_k, count(*) AS k, max(n) AS n
FROM r WHERE i < greatest(1, ceil(n * 0.2))""", ["scored"])
def q_sl03(spark, d):
    """SL-03: precision@K, K = max(1, ceil(0.2 n)), via the distributed row index."""
    return SL.precision_at_k(T.scored(spark, d), "p", "y", 0.2, tie="doc_id")


@query("sl_04_preview", """
SELECT location_id, date, AQI FROM daily_big ORDER BY date, location_id LIMIT 5""", ["daily_big"])
def q_sl04(spark, d):
    """SL-04: first 5 rows by date."""
    return SL.top_k(T.daily_big(spark, d).select("location_id", "date", "AQI"), [F.col("date"), F.col("location_id")], 5)


@query("sl_05_tail_by_date", """
SELECT date, n_orders FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS i, count(*) OVER () AS n FROM trends)
WHERE i <= greatest(30, n // 5)""", ["trends"])
def q_sl05(spark, d):
    """SL-05: the report window, the last max(30, n // 5) days, in ascending order."""
    t = T.trends(spark, d)
    return SL.tail_by_date(t, SL.report_window(t.count()))


@query("sl_06_next_dates", """
SELECT DISTINCT date FROM env_daily WHERE date >= DATE '2024-01-27' ORDER BY date LIMIT 7""", ["env_daily"])
def q_sl06(spark, d):
    """SL-06: next 7 distinct dates on/after 'today' (fallback: first 7)."""
    return SL.next_dates(T.env_daily(spark, d), "2024-01-27", 7)


# ---------------------------------------------------------------- sets / generators

@query("st_01_missing_pairs", """
WITH wanted AS (SELECT DISTINCT user_id, date FROM checkins),
have AS (SELECT user_id, date FROM checkins WHERE user_id % 2 = 0 AND symptomScore > 0)
SELECT user_id, date FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.user_id = w.user_id AND h.date = w.date)""",
       ["checkins"])
def q_st01(spark, d):
    """ST-01: (user, date) pairs wanted but not cached (left anti join)."""
    c = T.checkins(spark, d)
    wanted = ST.distinct_values(c, ["user_id", "date"])
    have = c.where((F.col("user_id") % 2 == 0) & (F.col("symptomScore") > 0))
    return ST.missing_pairs(wanted, have, ["user_id", "date"])


@query("st_02_distinct_users", "SELECT DISTINCT user_id FROM checkins", ["checkins"])
def q_st02(spark, d):
    """ST-02: distinct users."""
    return ST.distinct_values(T.checkins(spark, d), ["user_id"])


@query("st_03_first_available", """
WITH a AS (SELECT location_id, date, PM2_5_mean AS pm, 0 AS source_rank, pollen_tree IS NOT NULL AS ok FROM daily_big),
b AS (SELECT location_id, date, PM2_5_max AS pm, 1 AS source_rank, pollen_weed IS NOT NULL AS ok FROM daily_big),
c AS (SELECT location_id, date, AQI AS pm, 2 AS source_rank, true AS ok FROM daily_big WHERE CAST(location_id AS INTEGER) % 2 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT location_id, date, pm, source_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY location_id, date ORDER BY source_rank) AS rn FROM u WHERE ok) WHERE rn = 1""",
       ["daily_big"])
def q_st03(spark, d):
    """ST-03: per key, the first valid source in priority order (union + row_number)."""
    b = T.daily_big(spark, d)
    s1 = b.select("location_id", "date", F.col("PM2_5_mean").alias("pm"), "pollen_tree")
    s2 = b.select("location_id", "date", F.col("PM2_5_max").alias("pm"), F.col("pollen_weed").alias("pollen_tree"))
    s3 = b.where(F.col("location_id").cast("int") % 2 == 0) \
          .select("location_id", "date", F.col("AQI").alias("pm"), F.lit(1.0).alias("pollen_tree"))
    out = ST.first_available([s1, s2, s3], ["location_id", "date"],
                             [F.col("pollen_tree").isNotNull()] * 3)
    return out.select("location_id", "date", "pm", "source_rank")


@query("st_04_05_synthetic_env", """
WITH locs AS (SELECT DISTINCT location_id FROM env_daily),
days AS (SELECT location_id, unnest(generate_series(DATE '2024-02-01', DATE '2024-02-14', INTERVAL 1 DAY)) AS d FROM locs),
j AS (SELECT location_id, CAST(d AS DATE) AS date,
             ((date_diff('day', DATE '0001-01-01', CAST(d AS DATE)) + 1) % 7) / 7.0::DOUBLE AS j FROM days)
SELECT location_id, date, CAST(40 + floor(30 * j) AS DOUBLE) AS AQI, 10.0 + 8 * j AS PM2_5_mean,
       (10.0 + 8 * j) * 1.4 AS PM2_5_max, 55.0 + 20 * j AS humidity, 2.0 + 2 * j AS pollen_tree,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(floor((month(date) % 12 + 3) / 3) AS INTEGER) AS season
FROM j""", ["env_daily"])
def q_st04(spark, d):
    """ST-04 + ST-05: per-location 14-day spine (no join) with deterministic synthetic measures."""
    locs = T.env_daily(spark, d).select("location_id").distinct()
    rows = ST.expand_dates(locs, F.lit("2024-02-01").cast("date"), F.lit("2024-02-14").cast("date")).drop("day_idx")
    return ST.synthetic_env(rows, "risk").select("location_id", "date", "AQI", "PM2_5_mean", "PM2_5_max", "humidity",
                                                 "pollen_tree", "day_of_week", "season")


@query("st_06_work_items", """
WITH locs AS (SELECT DISTINCT location_id, min(date) OVER (PARTITION BY location_id) AS s FROM daily_big),
d AS (SELECT location_id, unnest(generate_series(0, 20)) AS day_idx, s FROM locs)
SELECT location_id, CAST(s + CAST(day_idx AS INTEGER) AS DATE) AS date, CAST(day_idx AS INTEGER) AS day_idx,
       CAST(floor(day_idx / 7) AS INTEGER) AS batch
FROM d""", ["daily_big"])
def q_st06(spark, d):
    """ST-06: backfill work items, each location x 21 days from its first day, in batches of 7."""
    locs = T.daily_big(spark, d).groupBy("location_id").agg(F.min("date").alias("s"))
    out = ST.expand_dates(locs, F.col("s"), F.date_add("s", 20), batch_days=7)
    return out.select("location_id", "date", F.col("day_idx").cast("int").alias("day_idx"), "batch")
