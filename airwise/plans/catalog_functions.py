"""Queries: scalar function families STR / DT / MA / AJ over derived text and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import arrays as A
from airwise.functions import dates as D
from airwise.functions import mathx as M
from airwise.functions import strings as S
from airwise.operators import windows as W
from airwise.plans.registry import query
from airwise.plans.sqlviews import holiday_sql
from airwise.sources import tables as T


@query("str_01_02_03_04_location_ids", """
WITH l AS (SELECT DISTINCT location_id, latitude, longitude, zip_code FROM daily_big),
x AS (SELECT *, CASE WHEN zip_code IS NOT NULL AND zip_code <> '' THEN 'zip_' || zip_code
                     ELSE CAST(sround(latitude, 4) AS VARCHAR) || '_' || CAST(sround(longitude, 4) AS VARCHAR) END AS loc_id
      FROM l)
SELECT location_id, printf('%.4f_%.4f', latitude, longitude) AS location_key, loc_id,
       regexp_replace(loc_id, '[_ ]', '', 'g') AS dash_id,
       regexp_replace(regexp_replace(loc_id, '[_ ]', '', 'g'), '^([^-]*)-', '\\1_') AS undashed,
       printf('%.2f-%.2f', latitude, longitude) AS two_dp,
       CASE WHEN len(string_split(loc_id, '_')) = 2 AND TRY_CAST(string_split(loc_id, '_')[1] AS DOUBLE) IS NOT NULL
                 AND TRY_CAST(string_split(loc_id, '_')[2] AS DOUBLE) IS NOT NULL
            THEN TRY_CAST(string_split(loc_id, '_')[1] AS DOUBLE) ELSE 37.0 END AS parsed_lat,
       CASE WHEN len(string_split(loc_id, '_')) = 2 AND TRY_CAST(string_split(loc_id, '_')[1] AS DOUBLE) IS NOT NULL
                 AND TRY_CAST(string_split(loc_id, '_')[2] AS DOUBLE) IS NOT NULL
            THEN TRY_CAST(string_split(loc_id, '_')[2] AS DOUBLE) ELSE -122.0 END AS parsed_lon
FROM x""", ["daily_big"])
def q_str01(spark, d):
    """STR-01 (padded key), STR-02 (zip-first id), STR-03 (dash forms), STR-04 (id -> lat/lon)."""
    l = T.daily_big(spark, d).select("location_id", "latitude", "longitude", "zip_code").distinct()
    lid = S.location_id("latitude", "longitude", "zip_code")
    x = l.withColumn("loc_id", lid)
    parsed = S.parse_location("loc_id")
    return x.select("location_id", S.location_key("latitude", "longitude", "zip_code").alias("location_key"), "loc_id",
                    S.dash_form("loc_id").alias("dash_id"), S.undash_form(S.dash_form("loc_id")).alias("undashed"),
                    S.two_dp_form("latitude", "longitude").alias("two_dp"),
                    parsed["lat"].alias("parsed_lat"), parsed["lon"].alias("parsed_lon"))


def _free_text(k):
    lat = 10 + k % 80 + (k % 10000) / 10000.0
    lon = -(70 + k % 50) - (k % 1000) / 1000.0
    return (F.when(k % 6 == 0, F.format_string("%.5f,%.5f", lat, lon))
            .when(k % 6 == 1, F.lpad((k % 99999).cast("string"), 5, "0"))
            .when(k % 6 == 2, F.concat(F.lpad((k % 99999).cast("string"), 5, "0"), F.lit("-1234")))
            .when(k % 6 == 3, F.lit("   "))
            .when(k % 6 == 4, F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
            .otherwise(F.concat((k % 90).cast("string"), F.lit(","), (k % 7).cast("string"))))


@query("str_05_free_text_location", """
WITH t AS (SELECT c_custkey,
  CASE WHEN c_custkey % 6 = 0 THEN printf('%.5f,%.5f', 10 + c_custkey % 80 + (c_custkey % 10000) / 10000.0::DOUBLE,
                                          -(70 + c_custkey % 50) - (c_custkey % 1000) / 1000.0::DOUBLE)
       WHEN c_custkey % 6 = 1 THEN lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0')
       WHEN c_custkey % 6 = 2 THEN lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') || '-1234'
       WHEN c_custkey % 6 = 3 THEN '   '
       WHEN c_custkey % 6 = 4 THEN ' ' || c_name || ' '
       ELSE CAST(c_custkey % 90 AS VARCHAR) || ',' || CAST(c_custkey % 7 AS VARCHAR) END AS txt FROM customer),
s AS (SELECT c_custkey, wtrim(txt) AS s FROM t)
SELECT c_custkey,
  CASE WHEN s IS NULL OR s = '' THEN NULL
       WHEN regexp_matches(s, '^(-?\\d+\\.?\\d*),(-?\\d+\\.?\\d*)$')
         THEN regexp_replace(CAST(floor(CAST(regexp_extract(s, '^(-?\\d+\\.?\\d*),(-?\\d+\\.?\\d*)$', 1) AS DOUBLE) * 10000 + 0.5) / 10000 AS VARCHAR), '\\.0$', '')
              || '_' || regexp_replace(CAST(floor(CAST(regexp_extract(s, '^(-?\\d+\\.?\\d*),(-?\\d+\\.?\\d*)$', 2) AS DOUBLE) * 10000 + 0.5) / 10000 AS VARCHAR), '\\.0$', '')
       WHEN regexp_matches(s, '^\\d{5}(-\\d{4})?$') THEN 'zip_' || substr(s, 1, 5)
       ELSE s END AS location_id
FROM s""", [])
def q_str05(spark, d):
    """STR-05: free text (lat,lon / ZIP / ZIP+4 / blank / other) -> location id."""
    c = T.raw(spark, d, "customer")
    return c.select("c_custkey", S.text_to_location_id(_free_text(F.col("c_custkey"))).alias("location_id"))


def _heights(k):
    return (F.when(k % 7 == 0, F.concat((150 + k % 50).cast("string"), F.lit(" cm")))
            .when(k % 7 == 1, F.concat(F.lit("1."), (50 + k % 49).cast("string"), F.lit(" m")))
            .when(k % 7 == 2, F.concat((4 + k % 3).cast("string"), F.lit("'"), (k % 12).cast("string"), F.lit('"')))
            .when(k % 7 == 3, F.concat((5 + k % 3).cast("string"), F.lit("' "), (k % 14).cast("string"), F.lit("in")))
            .when(k % 7 == 4, F.concat((5 + k % 4).cast("string"), F.lit("'")))
            .when(k % 7 == 5, F.lit(""))
            .otherwise(F.lit("abc")))


def _weights(k):
    return (F.when(k % 6 == 0, F.concat((50 + k % 60).cast("string"), F.lit(" kg")))
            .when(k % 6 == 1, F.concat((100 + k % 150).cast("string"), F.lit(" lbs")))
            .when(k % 6 == 2, (k % 200).cast("string"))
            .when(k % 6 == 3, F.lit("-3"))
            .when(k % 6 == 4, F.lit("abc"))
            .otherwise(F.concat((100 + k % 300).cast("string"), F.lit(" stone"))))


HEIGHT_SQL = """CASE WHEN c_custkey % 7 = 0 THEN CAST(150 + c_custkey % 50 AS VARCHAR) || ' cm'
  WHEN c_custkey % 7 = 1 THEN '1.' || CAST(50 + c_custkey % 49 AS VARCHAR) || ' m'
  WHEN c_custkey % 7 = 2 THEN CAST(4 + c_custkey % 3 AS VARCHAR) || '''' || CAST(c_custkey % 12 AS VARCHAR) || '"'
  WHEN c_custkey % 7 = 3 THEN CAST(5 + c_custkey % 3 AS VARCHAR) || ''' ' || CAST(c_custkey % 14 AS VARCHAR) || 'in'
  WHEN c_custkey % 7 = 4 THEN CAST(5 + c_custkey % 4 AS VARCHAR) || ''''
  WHEN c_custkey % 7 = 5 THEN '' ELSE 'abc' END"""
WEIGHT_SQL = """CASE WHEN c_custkey % 6 = 0 THEN CAST(50 + c_custkey % 60 AS VARCHAR) || ' kg'
  WHEN c_custkey % 6 = 1 THEN CAST(100 + c_custkey % 150 AS VARCHAR) || ' lbs'
  WHEN c_custkey % 6 = 2 THEN CAST(c_custkey % 200 AS VARCHAR)
  WHEN c_custkey % 6 = 3 THEN '-3' WHEN c_custkey % 6 = 4 THEN 'abc'
  ELSE CAST(100 + c_custkey % 300 AS VARCHAR) || ' stone' END"""


@query("str_06_07_08_09_ma_10_body_metrics", f"""
WITH t AS (SELECT c_custkey, wtrim({HEIGHT_SQL}) AS h, wtrim({WEIGHT_SQL}) AS w FROM customer),
p AS (SELECT c_custkey, h, w,
  CASE WHEN h = '' THEN NULL
       WHEN regexp_matches(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*cm$') THEN
         CASE WHEN CAST(regexp_extract(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*cm$', 1) AS DOUBLE) > 0
               AND CAST(regexp_extract(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*cm$', 1) AS DOUBLE) < 300
              THEN CAST(regexp_extract(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*cm$', 1) AS DOUBLE) / 100 END
       WHEN regexp_matches(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*m$') THEN
         CASE WHEN CAST(regexp_extract(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*m$', 1) AS DOUBLE) > 0
               AND CAST(regexp_extract(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*m$', 1) AS DOUBLE) < 3
              THEN CAST(regexp_extract(h, '(?i)^(\\d+(?:\\.\\d+)?)\\s*m$', 1) AS DOUBLE) END
       WHEN regexp_matches(h, '(?i)^(\\d+)\\s*[''’]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:["”]|in\\.?)?$') THEN
         CASE WHEN CAST(regexp_extract(h, '(?i)^(\\d+)\\s*[''’]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:["”]|in\\.?)?$', 1) AS INTEGER) BETWEEN 2 AND 8
               AND CAST(regexp_extract(h, '(?i)^(\\d+)\\s*[''’]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:["”]|in\\.?)?$', 2) AS DOUBLE) < 12
              THEN CAST(regexp_extract(h, '(?i)^(\\d+)\\s*[''’]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:["”]|in\\.?)?$', 1) AS INTEGER) * 0.3048::DOUBLE
                   + CAST(regexp_extract(h, '(?i)^(\\d+)\\s*[''’]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:["”]|in\\.?)?$', 2) AS DOUBLE) * 0.0254::DOUBLE END
       WHEN regexp_matches(h, '(?i)^(\\d+)\\s*[''’]?\\s*$') THEN
         CASE WHEN CAST(regexp_extract(h, '(?i)^(\\d+)\\s*[''’]?\\s*$', 1) AS INTEGER) BETWEEN 2 AND 8
              THEN CAST(regexp_extract(h, '(?i)^(\\d+)\\s*[''’]?\\s*$', 1) AS INTEGER) * 0.3048::DOUBLE END
  END AS height_m,
  CASE WHEN w = '' THEN NULL
       WHEN regexp_matches(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*kg$') THEN
         CASE WHEN CAST(regexp_extract(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*kg$', 1) AS DOUBLE) > 0
               AND CAST(regexp_extract(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*kg$', 1) AS DOUBLE) < 500
              THEN CAST(regexp_extract(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*kg$', 1) AS DOUBLE) END
       WHEN regexp_matches(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*(?:lbs?|lb)?$') THEN
         CASE WHEN CAST(regexp_extract(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*(?:lbs?|lb)?$', 1) AS DOUBLE) > 0
               AND CAST(regexp_extract(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*(?:lbs?|lb)?$', 1) AS DOUBLE) < 1500
              THEN CAST(regexp_extract(w, '(?i)^(\\d+(?:\\.\\d+)?)\\s*(?:lbs?|lb)?$', 1) AS DOUBLE) / 2.205::DOUBLE END
       WHEN TRY_CAST(regexp_extract(w, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) IS NULL
         OR TRY_CAST(regexp_extract(w, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) <= 0 THEN NULL
       WHEN TRY_CAST(regexp_extract(w, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) < 150
         THEN TRY_CAST(regexp_extract(w, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE)
       ELSE TRY_CAST(regexp_extract(w, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) / 2.205::DOUBLE
  END AS weight_kg,
  CASE WHEN position('''' IN replace(lower(h), ' ', '')) > 0 THEN
    TRY_CAST(split_part(replace(lower(h), ' ', ''), '''', 1) AS DOUBLE) * 12
    + CASE WHEN wtrim(replace(substr(replace(lower(h), ' ', ''), position('''' IN replace(lower(h), ' ', '')) + 1), '"', '')) = '' THEN 0
           ELSE TRY_CAST(wtrim(replace(substr(replace(lower(h), ' ', ''), position('''' IN replace(lower(h), ' ', '')) + 1), '"', '')) AS DOUBLE) END
  END AS height_in,
  TRY_CAST(wtrim(replace(replace(lower(w), 'lbs', ''), 'lb', '')) AS DOUBLE) AS weight_lb
  FROM t)
SELECT c_custkey, height_m, weight_kg, height_in, weight_lb,
  CASE WHEN height_m > 0 AND floor(weight_kg / (height_m * height_m) * 10 + 0.5) / 10 > 10
        AND floor(weight_kg / (height_m * height_m) * 10 + 0.5) / 10 < 80
       THEN floor(weight_kg / (height_m * height_m) * 10 + 0.5) / 10 END AS bmi
FROM p""", [])
def q_str06(spark, d):
    """STR-06 (height in), STR-07 (weight lb), STR-08 (height m), STR-09 (weight kg), MA-10 (BMI)."""
    c = T.raw(spark, d, "customer")
    k = F.col("c_custkey")
    t = c.select("c_custkey", S.ws_trim(_heights(k)).alias("h"), S.ws_trim(_weights(k)).alias("w"))
    hm, wk = S.height_m("h"), S.weight_kg("w")
    p = t.select("c_custkey", hm.alias("height_m"), wk.alias("weight_kg"), S.height_in("h").alias("height_in"),
                 S.weight_lb("w").alias("weight_lb"))
    return p.select("*", M.bmi("height_m", "weight_kg").alias("bmi"))


@query("str_10_11_13_messages", """
WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'rec-' || CAST(page_id AS VARCHAR) ELSE s END AS slug,
       coalesce(nullif(wtrim(title), ''), 'there') AS display
FROM (SELECT page_id, title, regexp_replace(lower(regexp_replace(coalesce(title, ''), '\\s+', '-', 'g')), '[^a-z0-9-]', '', 'g') AS s FROM t)""",
       [])
def q_str10(spark, d):
    """STR-10 (slug of the whole page title, 'rec-<id>' when empty) and STR-13 (display name fallback)."""
    p = T.raw(spark, d, "pages")
    t = p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return t.select("page_id", S.slug("title", "page_id").alias("slug"), S.display_name("title").alias("display"))


@query("str_11_chat_messages", """
SELECT conv_id, turn, CASE WHEN role IN ('model', 'assistant') THEN 'model' ELSE 'user' END AS role, wtrim(text) AS text
FROM conversations WHERE length(wtrim(text)) > 0""", [])
def q_str11(spark, d):
    """STR-11: message normalisation (model/assistant -> model, else user), trimmed, empties dropped."""
    c = T.raw(spark, d, "conversations")
    return c.select("conv_id", "turn", S.chat_role("role").alias("role"), S.ws_trim("text").alias("text")) \
        .where(F.length("text") > 0)


@query("str_12_14_ma_11_display_texts", """
SELECT location_id, date,
  CASE WHEN temp_min IS NULL AND temp_max IS NULL THEN NULL
       ELSE array_to_string(list_filter([CAST(CAST(floor(temp_min * 9.0 / 5.0 + 32 + 0.5) AS BIGINT) AS VARCHAR),
                                         CAST(CAST(floor(temp_max * 9.0 / 5.0 + 32 + 0.5) AS BIGINT) AS VARCHAR)],
                                        lambda x: x IS NOT NULL), '–') || '°F' END AS temp_text,
  CASE WHEN PM2_5_mean IS NOT NULL AND PM2_5_max IS NOT NULL
         THEN 'Avg ' || CAST(floor(PM2_5_mean * 10 + 0.5) / 10 AS VARCHAR) || ', high ' || CAST(floor(PM2_5_max * 10 + 0.5) / 10 AS VARCHAR)
       WHEN PM2_5_mean IS NOT NULL THEN 'Avg ' || CAST(floor(PM2_5_mean * 10 + 0.5) / 10 AS VARCHAR)
       WHEN PM2_5_max IS NOT NULL THEN 'High ' || CAST(floor(PM2_5_max * 10 + 0.5) / 10 AS VARCHAR) ELSE '—' END AS pm_text,
  coalesce(CAST(pollen_weed AS VARCHAR), '—') AS weed_text,
  CASE WHEN pollen_tree IS NULL OR isnan(pollen_tree) THEN '—'
       WHEN (CASE WHEN pollen_tree <= 12 THEN pollen_tree ELSE pollen_tree / 5 END) <= 3 THEN 'Low'
       WHEN (CASE WHEN pollen_tree <= 12 THEN pollen_tree ELSE pollen_tree / 5 END) <= 7 THEN 'Moderate' ELSE 'High' END AS tree_severity
FROM (SELECT location_id, date, CASE WHEN date < DATE '1996-01-01' THEN NULL ELSE temp_min END AS temp_min, temp_max,
             CASE WHEN date < DATE '1995-06-01' THEN NULL ELSE PM2_5_mean END AS PM2_5_mean, PM2_5_max,
             sround(pollen_weed, 1) AS pollen_weed, pollen_tree FROM daily_big)""", ["daily_big"])
def q_str12(spark, d):
    """STR-12 ('—' for nulls), STR-14 (temperature range / PM text), MA-11 (pollen severity)."""
    e = T.daily_big(spark, d)
    e = e.select("location_id", "date",
                 F.when(F.col("date") < "1996-01-01", F.lit(None).cast("double")).otherwise(F.col("temp_min")).alias("temp_min"),
                 "temp_max",
                 F.when(F.col("date") < "1995-06-01", F.lit(None).cast("double")).otherwise(F.col("PM2_5_mean")).alias("PM2_5_mean"),
                 "PM2_5_max", F.round("pollen_weed", 1).alias("pollen_weed"), "pollen_tree")
    return e.select("location_id", "date", S.temp_range_text("temp_min", "temp_max").alias("temp_text"),
                    S.pm_text("PM2_5_mean", "PM2_5_max").alias("pm_text"),
                    S.dash_if_null("pollen_weed").alias("weed_text"),
                    M.pollen_severity("pollen_tree").alias("tree_severity"))


@query("dt_01_02_03_05_06_calendar", f"""
SELECT date, dayname(date) AS day_name, CAST(isodow(date) - 1 AS INTEGER) AS weekday_num, CAST(month(date) AS INTEGER) AS month,
  CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring'
       WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season_autumn,
  CAST(floor((month(date) % 12 + 3) / 3) AS INTEGER) AS season_num,
  CAST(floor((month(date) % 12 + 3) / 3) - 1 AS INTEGER) AS season_idx,
  {holiday_sql('date')} AS is_holiday
FROM trends""", ["trends"])
def q_dt01(spark, d):
    """DT-01 (weekday name / number, month), DT-02/03 (season name / number), DT-05/06 (holiday, context)."""
    t = T.trends(spark, d)
    ctx = D.time_context("date")
    return t.select("date", ctx["day_of_week"].alias("day_name"), ctx["day_of_week_num"].alias("weekday_num"),
                    F.month("date").alias("month"), ctx["season"].alias("season_autumn"),
                    D.season_num(F.month("date")).alias("season_num"),
                    D.season_num(F.month("date"), zero_based=True).alias("season_idx"),
                    ctx["is_holiday"].alias("is_holiday"))


@query("dt_04_nth_weekday_holidays", """
WITH y AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM trends)
SELECT year,
  make_date(year, 1, 1) + CAST(((0 - (isodow(make_date(year, 1, 1)) - 1) + 7) % 7) + 14 AS INTEGER) AS mlk_day,
  make_date(year, 9, 1) + CAST(((0 - (isodow(make_date(year, 9, 1)) - 1) + 7) % 7) AS INTEGER) AS labor_day,
  make_date(year, 11, 1) + CAST(((3 - (isodow(make_date(year, 11, 1)) - 1) + 7) % 7) + 21 AS INTEGER) AS thanksgiving
FROM y""", ["trends"])
def q_dt04(spark, d):
    """DT-04: n-th weekday of a month, per year of the data (MLK, Labor Day, Thanksgiving)."""
    y = T.trends(spark, d).select(F.year("date").alias("year")).distinct()
    return y.select("year", D.nth_weekday("year", 1, 0, 3).alias("mlk_day"), D.nth_weekday("year", 9, 0, 1).alias("labor_day"),
                    D.nth_weekday("year", 11, 3, 4).alias("thanksgiving"))


@query("dt_07_08_interval_dates", """
WITH g AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '-07:00' ELSE '+00:00' END || '/PT1H' AS valid_time,
                  strftime(ts, '%Y-%m-%d') AS iso FROM events)
SELECT event_id, CAST(substr(valid_time, 1, 10) AS DATE) AS start_date, CAST(iso AS DATE) AS iso_date FROM g""", [])
def q_dt07(spark, d):
    """DT-07 (interval start date in the text's own offset) and DT-08 (ISO text -> date)."""
    ev = T.raw(spark, d, "events")
    vt = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                  F.when(F.col("event_id") % 2 == 0, F.lit("-07:00")).otherwise(F.lit("+00:00")), F.lit("/PT1H"))
    return ev.select("event_id", D.interval_start_date(vt).alias("start_date"),
                     D.to_utc_date(F.date_format("ts", "yyyy-MM-dd")).alias("iso_date"))


@query("ma_01_unit_conversions", """
SELECT event_id, (value - 32) * 5.0::DOUBLE / 9.0 AS temp_c, CAST(floor(value * 9.0::DOUBLE / 5.0 + 32 + 0.5) AS INTEGER) AS temp_f,
       value * 1.60934::DOUBLE AS wind_kmh,
       CASE WHEN contains(lower(CASE WHEN event_id % 2 = 0 THEN 'Pa' ELSE 'inHg' END), 'pa') THEN value ELSE value * 3386.389::DOUBLE END AS pressure_pa,
       CASE WHEN event_id % 5 IN (0, 1) THEN value * 25.4::DOUBLE ELSE value END AS rain_mm
FROM events""", [])
def q_ma01(spark, d):
    """MA-01: F->C, C->F (rounded half up), mph->km/h, inHg->Pa unless the unit says Pa, in->mm."""
    ev = T.raw(spark, d, "events")
    v = F.col("value")
    p_uom = F.when(F.col("event_id") % 2 == 0, F.lit("Pa")).otherwise(F.lit("inHg"))
    # exactly "in" or "inch" is inches; a unit that merely holds these letters is not
    units = F.array(*[F.lit(u) for u in ("inch", "IN", "mm", "wmoUnit:min", None)])
    r_uom = F.element_at(units, (F.col("event_id") % 5 + 1).cast("int"))
    return ev.select("event_id", M.f_to_c(v).alias("temp_c"), M.c_to_f_rounded(v).alias("temp_f"),
                     M.mph_to_kmh(v).alias("wind_kmh"), M.pressure_to_pa(v, p_uom).alias("pressure_pa"),
                     M.rain_to_mm(v, r_uom).alias("rain_mm"))


# Fixed values: (AQI up to, PM from, PM span, AQI from, AQI span) of AQI -> PM2.5, written out for the SQL twin.
AQI_PM_SQL_SEGMENTS = [
    (50, 12.1, 23.299999999999997, 0, 50),
    (100, 35.5, 19.9, 50, 50),
    (150, 55.5, 94.9, 100, 50),
    (200, 150.5, 99.9, 150, 50),
    (300, 250.5, 99.89999999999998, 200, 100),
    (500, 350.5, 149.89999999999998, 300, 200),
]
# Fixed values: (PM from, PM up to, AQI from, AQI up to) of PM2.5 -> AQI, written out for the SQL twin.
PM_AQI_SQL_SEGMENTS = [
    (0.0, 12.0, 0, 50),
    (12.0, 35.4, 50, 100),
    (35.4, 55.4, 100, 150),
    (55.4, 150.4, 150, 250),
    (150.4, 250.4, 200, 300),
    (250.4, 500.4, 300, 500),
]


def _aqi_pm_sql(a: str) -> str:
    parts = [f"WHEN {a} <= 12 THEN {a}"]
    for hi, c_lo, c_span, a_lo, a_span in AQI_PM_SQL_SEGMENTS:
        parts.append(f"WHEN {a} <= {hi} THEN {c_lo!r}::DOUBLE + ({a} - {a_lo}) * {c_span!r}::DOUBLE / {a_span}")
    return "CASE " + " ".join(parts) + " ELSE 500.4::DOUBLE END"


def _pm_aqi_sql(p: str) -> str:
    parts = [f"WHEN {p} <= 12.0::DOUBLE THEN CASE WHEN {p} >= 0 THEN {p} * (50.0::DOUBLE / 12.0::DOUBLE) ELSE 0.0::DOUBLE END"]
    for lo, hi, a_lo, a_hi in PM_AQI_SQL_SEGMENTS[1:]:
        parts.append(f"WHEN {p} <= {hi!r}::DOUBLE THEN {a_lo} + ({p} - {lo!r}::DOUBLE) * ({a_hi - a_lo}.0::DOUBLE / ({hi!r}::DOUBLE - {lo!r}::DOUBLE))")
    return "CAST(trunc(CASE " + " ".join(parts) + " ELSE 500.0::DOUBLE END) AS INTEGER)"


@query("ma_02_03_aqi_pm_segments", f"""
WITH x AS (SELECT event_id, CAST(value AS DOUBLE) AS a, value / 2 AS p FROM events
           UNION ALL SELECT -1, 12.0, 12.0 UNION ALL SELECT -2, 12.1, 35.4 UNION ALL SELECT -3, 50.0, 500.4
           UNION ALL SELECT -4, 500.0, 600.0 UNION ALL SELECT -5, 501.0, -1.0)
SELECT event_id, {_aqi_pm_sql('a')} AS pm_from_aqi, {_pm_aqi_sql('p')} AS aqi_from_pm FROM x""", [])
def q_ma02(spark, d):
    """MA-02 (AQI -> PM2.5 segments) and MA-03 (PM2.5 -> AQI, cap 500, truncation), with edge values."""
    ev = T.raw(spark, d, "events").select("event_id", F.col("value").alias("a"), (F.col("value") / 2).alias("p"))
    edges = ev.sparkSession.createDataFrame([(-1, 12.0, 12.0), (-2, 12.1, 35.4), (-3, 50.0, 500.4), (-4, 500.0, 600.0),
                                             (-5, 501.0, -1.0)], "event_id long, a double, p double")
    x = ev.unionByName(edges)
    return x.select("event_id", M.aqi_to_pm25("a").alias("pm_from_aqi"), M.pm25_to_aqi("p").alias("aqi_from_pm"))


@query("ma_06_07_class_scores", """
WITH x AS (SELECT doc_id, [1 - p, p * 0.5, p * 0.3, p * 0.2] AS probs FROM scored)
SELECT doc_id, sround(list_sum(list_transform(range(1, 5), lambda i: probs[i] * i)), 2) AS expected_score,
       sround(list_max(probs), 2) AS probability,
       CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS argmax,
       sround(greatest(1.0::DOUBLE, least(5.0::DOUBLE, CASE WHEN list_sum(list_transform(range(1, 5), lambda i: probs[i] * i)) - 1.5 <= 0 THEN 1.5
             ELSE list_sum(list_transform(range(1, 5), lambda i: probs[i] * i)) - 1.5 END)), 2) AS display_score
FROM x""", ["scored"])
def q_ma06(spark, d):
    """MA-06 (expected class score, max probability), AJ-05 (argmax), MA-07 (display score)."""
    s = T.scored(spark, d)
    p = F.col("p")
    x = s.select("doc_id", F.array(1 - p, p * 0.5, p * 0.3, p * 0.2).alias("probs"))
    classes = F.array(*[F.lit(i) for i in (1, 2, 3, 4)])
    raw = F.aggregate(F.zip_with("probs", classes, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return x.select("doc_id", M.expected_class_score("probs", classes).alias("expected_score"),
                    M.max_probability("probs").alias("probability"), A.argmax("probs").alias("argmax"),
                    M.display_score(raw - 1.5).alias("display_score"))


@query("ma_09_12_date_hash_and_clamp", """
SELECT date, n_orders,
  sround(greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1.5 + (list_sum(list_transform(string_split(strftime(date, '%Y-%m-%d'), ''), lambda ch: ascii(ch))) % 30) / 10.0::DOUBLE)), 1) AS hash_score,
  least(greatest(coalesce(TRY_CAST(CASE WHEN n_orders % 4 = 0 THEN 'x' ELSE CAST(n_orders - 9 AS VARCHAR) END AS DOUBLE), 0.0), 0.0), 3.0) AS clamped
FROM trends""", ["trends"])
def q_ma09(spark, d):
    """MA-09 (date-hash fallback score) and MA-12 (non-number -> 0, clamp to 0..3)."""
    t = T.trends(spark, d)
    txt = F.when(F.col("n_orders") % 4 == 0, F.lit("x")).otherwise((F.col("n_orders") - 9).cast("string"))
    return t.select("date", "n_orders", M.date_hash_score(F.date_format("date", "yyyy-MM-dd")).alias("hash_score"),
                    M.clamp_number(txt, 0, 3).alias("clamped"))


@query("ma_17_18_aj_06_lookups", """
WITH x AS (SELECT conv_id, turn,
  (['none', 'Low', 'MEDIUM', 'heavy', 'Extremely Heavy', 'unknown'])[CAST(turn % 6 AS INTEGER) + 1] AS word,
  (['Monday', 'tuesday', '3', 'FRIDAY', 'noday', '-1'])[CAST(conv_id % 6 AS INTEGER) + 1] AS dow,
  (['wind', 'sprout', 'thermometer', 'droplets', 'other'])[CAST((conv_id + turn) % 5 AS INTEGER) + 1] AS icon_key
  FROM conversations)
SELECT conv_id, turn,
  CASE lower(wtrim(word)) WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'heavy' THEN 3 WHEN 'extremely heavy' THEN 4 END AS level_idx,
  CASE WHEN TRY_CAST(dow AS INTEGER) IS NOT NULL THEN CAST(((TRY_CAST(dow AS INTEGER) % 7) + 7) % 7 AS INTEGER)
       WHEN list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], lower(wtrim(dow))) IS NOT NULL
         THEN CAST(list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], lower(wtrim(dow))) - 1 AS INTEGER)
       ELSE 0 END AS dow_idx,
  CASE icon_key WHEN 'wind' THEN 'Wind' WHEN 'sprout' THEN 'Sprout' WHEN 'thermometer' THEN 'Thermometer' WHEN 'droplets' THEN 'Droplets' END AS icon
FROM x""", [])
def q_ma17(spark, d):
    """MA-17 (level word -> index), MA-18 (category -> index, modulo, case, unknown -> 0), AJ-06 (icon map)."""
    c = T.raw(spark, d, "conversations")
    word = W.cycle_pick(["none", "Low", "MEDIUM", "heavy", "Extremely Heavy", "unknown"], F.col("turn"))
    dow = W.cycle_pick(["Monday", "tuesday", "3", "FRIDAY", "noday", "-1"], F.col("conv_id"))
    icon = W.cycle_pick(["wind", "sprout", "thermometer", "droplets", "other"], F.col("conv_id") + F.col("turn"))
    return c.select("conv_id", "turn", M.level_index(word).alias("level_idx"),
                    M.category_index(dow, [n.lower() for n in D.WEEKDAY_NAMES]).alias("dow_idx"),
                    A.icon_for(icon).alias("icon"))


def _reply_text():
    c = F.col
    desc = F.regexp_replace(c("text"), r'["\\\n\r\t]', " ")
    item = F.concat(F.lit('{"id": "'), c("role"), F.lit(" "), c("turn").cast("string"), F.lit('", "title": "'),
                    F.when(c("turn") % 4 == 0, F.lit("  ")).otherwise(c("role")), F.lit('", "description": "'), desc,
                    F.lit('"}'))
    arr = F.concat(F.lit("["), item, F.lit(", "), item, F.lit("]"))
    return (F.when(c("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
            .when(c("conv_id") % 3 == 1, F.concat(F.lit('{"recommendations": '), arr, F.lit("}")))
            .otherwise(F.concat(F.lit("Here you go: "), arr)))


@query("aj_03_str_10_parse_recommendations", r"""
WITH t AS (SELECT conv_id, turn,
  '{"id": "' || role || ' ' || CAST(turn AS VARCHAR) || '", "title": "' || CASE WHEN turn % 4 = 0 THEN '  ' ELSE role END
  || '", "description": "' || regexp_replace(text, '["\\\n\r\t]', ' ', 'g') || '"}' AS item FROM conversations),
r AS (SELECT conv_id, turn, '[' || item || ', ' || item || ']' AS arr FROM t),
items AS (SELECT conv_id, turn, unnest(from_json(arr, '[{"id": "VARCHAR", "title": "VARCHAR", "description": "VARCHAR"}]')) AS it
          FROM r WHERE conv_id % 3 <> 1),
kept AS (SELECT conv_id, turn, count(*) AS n,
                min(regexp_replace(lower(regexp_replace(coalesce(it.id, ''), '\s+', '-', 'g')), '[^a-z0-9-]', '', 'g')) AS s
         FROM items WHERE length(wtrim(coalesce(it.title, ''))) > 0 AND length(wtrim(coalesce(it.description, ''))) > 0
         GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, CAST(coalesce(k.n, 5) AS INTEGER) AS n_items, coalesce(k.s, 'limit-outdoor') AS first_slug
FROM conversations c LEFT JOIN kept k ON k.conv_id = c.conv_id AND k.turn = c.turn""", [])
def q_aj03(spark, d):
    """AJ-03 (JSON list out of model text: fence content, first '[' onward, object wrappers;
    items need title and description; default list when nothing is left) and STR-10 (ids as slugs)."""
    c = T.raw(spark, d, "conversations")
    items = c.select("conv_id", "turn", A.parse_recommendations(_reply_text()).alias("items"))
    return items.select("conv_id", "turn", F.size("items").cast("int").alias("n_items"),
                        F.col("items")[0]["id"].alias("first_slug"))
