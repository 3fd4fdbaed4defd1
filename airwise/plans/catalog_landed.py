"""Queries: landed payload parsing (SRC-06 .. SRC-10) and payload rollups (AG-05, AG-06, AG-07).

Each reading (event) lands as one payload text built from its own values, so the
payload volume grows with the event table; parsing is per row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.plans.catalog_functions import _aqi_pm_sql, _pm_aqi_sql
from airwise.plans.registry import query
from airwise.sources import landed as LD
from airwise.sources import tables as T


def _s(c):
    return F.col(c).cast("string")


def hour_text(offset_hours: int):
    t = F.date_trunc("hour", F.col("ts"))
    if offset_hours:
        t = t + F.expr(f"INTERVAL {offset_hours} HOURS")
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm")


def payloads(spark, d):
    """One landed payload per reading for each source kind."""
    r = T.readings(spark, d)
    ts_txt = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    eid = F.col("event_id")
    hourly = F.concat(F.lit('{"hourly": {"time": ["'), hour_text(0), F.lit('", "'), hour_text(1), F.lit('", "'),
                      hour_text(2), F.lit('"], "temperature_2m": ['), _s("pm"), F.lit(", "), _s("k"),
                      F.lit(', null], "relative_humidity_2m": ['), _s("k"), F.lit("]}}"))
    mm = F.when(eid % 4 == 0, F.concat(
        F.lit('"minTemperature": {"uom": "wmoUnit:degF", "values": [{"validTime": "'), ts_txt,
        F.lit('-07:00/PT1H", "value": '), _s("k"), F.lit('}]}, "maxTemperature": {"uom": "wmoUnit:degF", "values": '
                                                         '[{"validTime": "'), ts_txt, F.lit('-07:00/PT1H", "value": '),
        _s("pm"), F.lit("}]}, "))).otherwise(F.lit(""))
    grid = F.concat(
        F.lit('{"properties": {'), mm,
        F.lit('"temperature": {"uom": "wmoUnit:degF", "values": [{"validTime": "'), ts_txt,
        F.lit('-07:00/PT1H", "value": '), _s("pm"), F.lit('}, {"validTime": "'), ts_txt,
        F.lit('+00:00/PT2H", "value": "n/a"}]}, "relativeHumidity": {"uom": "wmoUnit:percent", "values": [{"validTime": "'),
        ts_txt, F.lit('+00:00/PT1H", "value": '), _s("k"),
        F.lit('}]}, "windSpeed": {"uom": "wmoUnit:mph", "values": [{"validTime": "'), ts_txt,
        F.lit('+00:00/PT1H", "value": '), _s("k"),
        F.lit('}]}, "pressure": {"uom": "'), F.when(eid % 2 == 0, F.lit("wmoUnit:Pa")).otherwise(F.lit("inHg")),
        F.lit('", "values": [{"validTime": "'), ts_txt, F.lit('+00:00/PT1H", "value": '), _s("pm"),
        F.lit('}]}, "quantitativePrecipitation": {"uom": "'), F.when(eid % 3 == 0, F.lit("in")).otherwise(F.lit("mm")),
        F.lit('", "values": [{"validTime": "'), ts_txt, F.lit('+00:00/PT6H", "value": '), _s("pm"), F.lit("}]}}}"))
    date_txt = F.date_format("ts", "yyyy-MM-dd")
    conc = F.when(eid % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"RawConcentration": "'), _s("pm"), F.lit('", ')))
    obs_one = F.concat(F.lit('{"ParameterName": "PM2.5", "AQI": '), _s("k"), F.lit(", "), conc,
                       F.lit('"Category": {"Name": "Good"}, "DateObserved": "'), date_txt, F.lit('"}'))
    obs_arr = F.concat(F.lit('[{"ParameterName": "PM2.5", "AQI": '), _s("k"), F.lit(", "), conc,
                       F.lit('"CategoryName": "Moderate", "DateObserved": "'), date_txt,
                       F.lit('"}, {"ParameterName": "O3", "AQI": 7, "CategoryName": "Good", "DateObserved": "'),
                       date_txt, F.lit('"}]'))
    obs = F.when(eid % 3 == 0, obs_one).otherwise(obs_arr)
    sensors = F.concat(F.lit('{"data": [['), _s("event_id"), F.lit(", "), _s("pm"), F.lit(", "), _s("k"),
                       F.lit("], ["), _s("k"), F.lit(", "), _s("pm"), F.lit("], ["), _s("k"), F.lit("]]}"))
    return r.select("event_id", "location_id", "date", hourly.alias("hourly_json"), grid.alias("grid_json"),
                    obs.alias("obs_json"), sensors.alias("sensor_json"))


PAYLOAD_SQL = """
pl AS (SELECT event_id, location_id, date, ts, k, pm,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_txt, strftime(ts, '%Y-%m-%d') AS date_txt,
  '{"hourly": {"time": ["' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M') || '", "'
    || strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M') || '", "'
    || strftime(date_trunc('hour', ts) + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M') || '"], "temperature_2m": ['
    || CAST(pm AS VARCHAR) || ', ' || CAST(k AS VARCHAR) || ', null], "relative_humidity_2m": [' || CAST(k AS VARCHAR) || ']}}' AS hourly_json
  FROM readings)"""


@query("src_06_parallel_arrays", "WITH " + PAYLOAD_SQL + """,
h AS (SELECT event_id, location_id,
        CAST(json_extract(hourly_json, '$.hourly.time') AS VARCHAR[]) AS t,
        CAST(json_extract(hourly_json, '$.hourly.temperature_2m') AS DOUBLE[]) AS temp,
        CAST(json_extract(hourly_json, '$.hourly.relative_humidity_2m') AS DOUBLE[]) AS hum FROM pl),
s AS (SELECT *, unnest(range(greatest(len(t), len(temp), len(hum)))) AS slot FROM h)
SELECT event_id, location_id, CAST(slot AS INTEGER) AS slot, CAST(t[slot + 1] AS TIMESTAMP) AS time,
       temp[slot + 1] AS temperature_2m, hum[slot + 1] AS relative_humidity_2m FROM s""", ["readings"])
def q_src06(spark, d):
    """SRC-06: hourly parallel-array payloads -> one row per slot (short arrays padded with null)."""
    p = payloads(spark, d)
    return LD.explode_parallel_arrays(p, "hourly_json", "hourly", ["temperature_2m", "relative_humidity_2m"],
                                      keep=["event_id", "location_id"])


GRID_SQL = """
g AS (SELECT location_id, ts_txt, k, pm, event_id FROM pl),
iv AS (
  SELECT location_id, 'minTemperature' AS variable, 'wmoUnit:degF' AS uom, ts_txt || '-07:00/PT1H' AS vt, CAST(k AS DOUBLE) AS value FROM g WHERE event_id % 4 = 0
  UNION ALL SELECT location_id, 'maxTemperature', 'wmoUnit:degF', ts_txt || '-07:00/PT1H', pm FROM g WHERE event_id % 4 = 0
  UNION ALL SELECT location_id, 'temperature', 'wmoUnit:degF', ts_txt || '-07:00/PT1H', pm FROM g
  UNION ALL SELECT location_id, 'relativeHumidity', 'wmoUnit:percent', ts_txt || '+00:00/PT1H', CAST(k AS DOUBLE) FROM g
  UNION ALL SELECT location_id, 'windSpeed', 'wmoUnit:mph', ts_txt || '+00:00/PT1H', CAST(k AS DOUBLE) FROM g
  UNION ALL SELECT location_id, 'pressure', CASE WHEN event_id % 2 = 0 THEN 'wmoUnit:Pa' ELSE 'inHg' END, ts_txt || '+00:00/PT1H', pm FROM g
  UNION ALL SELECT location_id, 'quantitativePrecipitation', CASE WHEN event_id % 3 = 0 THEN 'in' ELSE 'mm' END, ts_txt || '+00:00/PT6H', pm FROM g),
ivd AS (SELECT *, CAST(substr(vt, 1, 10) AS DATE) AS date FROM iv)"""


@query("src_07_grid_intervals", "WITH " + PAYLOAD_SQL + "," + GRID_SQL + """
SELECT location_id, variable, uom, vt AS valid_time, date, value FROM ivd""", ["readings"])
def q_src07(spark, d):
    """SRC-07 (+DT-07): grid forecast payloads -> (variable, start date, value); 'n/a' values dropped."""
    p = payloads(spark, d)
    return LD.explode_intervals(p, "grid_json", keep=["location_id"])


@query("ag_06_daily_grid_weather", "WITH " + PAYLOAD_SQL + "," + GRID_SQL + """,
a AS (SELECT location_id, date,
  min(CASE WHEN variable = 'minTemperature' THEN value END) AS mn, max(CASE WHEN variable = 'maxTemperature' THEN value END) AS mx,
  min(CASE WHEN variable = 'temperature' THEN value END) AS tmn, max(CASE WHEN variable = 'temperature' THEN value END) AS tmx,
  sum(CAST(CASE WHEN variable = 'relativeHumidity' THEN value END AS DECIMAL(24, 6))) / count(CASE WHEN variable = 'relativeHumidity' THEN value END) AS hm, max(CASE WHEN variable = 'relativeHumidity' THEN value END) AS hx,
  sum(CAST(CASE WHEN variable = 'windSpeed' THEN value END AS DECIMAL(24, 6))) / count(CASE WHEN variable = 'windSpeed' THEN value END) AS w,
  sum(CAST(CASE WHEN variable = 'pressure' THEN value END AS DECIMAL(24, 6))) / count(CASE WHEN variable = 'pressure' THEN value END) AS p, max(CASE WHEN variable = 'pressure' THEN uom END) AS pu,
  sum(CASE WHEN variable = 'quantitativePrecipitation' THEN value END) AS r,
  max(CASE WHEN variable = 'quantitativePrecipitation' THEN uom END) AS ru
  FROM ivd GROUP BY location_id, date)
SELECT location_id, date,
  sround((CASE WHEN mn IS NULL AND mx IS NULL THEN tmn ELSE mn END - 32) * 5.0::DOUBLE / 9.0, 2) AS temp_min_c,
  sround((CASE WHEN mn IS NULL AND mx IS NULL THEN tmx ELSE mx END - 32) * 5.0::DOUBLE / 9.0, 2) AS temp_max_c,
  sround(hm, 2) AS humidity_mean, sround(hx, 2) AS humidity_max, sround(w * 1.60934::DOUBLE, 2) AS wind_speed_kmh,
  sround(CASE WHEN contains(lower(coalesce(pu, '')), 'pa') THEN p ELSE p * 3386.389::DOUBLE END, 2) AS pressure_pa,
  sround(CASE WHEN lower(coalesce(ru, '')) IN ('in', 'inch') THEN r * 25.4::DOUBLE ELSE r END, 2) AS rain_mm
FROM a""", ["readings"])
def q_ag06(spark, d):
    """AG-06 (+MA-01): grid intervals -> daily weather per location with unit conversion."""
    iv = LD.explode_intervals(payloads(spark, d), "grid_json", keep=["location_id"])
    return LD.daily_grid(iv, ["location_id"])


OBS_SQL = """
ob AS (
  SELECT location_id, date, 'PM2.5' AS ParameterName, CAST(k AS DOUBLE) AS AQI,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE pm END AS concentration,
         CASE WHEN event_id % 3 = 0 THEN 'Good' ELSE 'Moderate' END AS category, date_txt AS DateObserved FROM pl
  UNION ALL SELECT location_id, date, 'O3', 7.0, NULL, 'Good', date_txt FROM pl WHERE event_id % 3 <> 0)"""


@query("src_08_observations", "WITH " + PAYLOAD_SQL + "," + OBS_SQL + """
SELECT location_id, ParameterName, AQI, concentration, category, DateObserved FROM ob""", ["readings"])
def q_src08(spark, d):
    """SRC-08: observation payloads (object or array) -> rows; category from either field."""
    return LD.parse_observations(payloads(spark, d), "obs_json", keep=["location_id"]) \
        .select("location_id", "ParameterName", "AQI", "concentration", "category", "DateObserved")


@query("ag_05_daily_observations", "WITH " + PAYLOAD_SQL + "," + OBS_SQL + f""",
x AS (SELECT location_id, date, AQI,
        CASE WHEN ParameterName = 'PM2.5' THEN coalesce(concentration, {_aqi_pm_sql('AQI')}) END AS pm FROM ob)
SELECT location_id, date, sround(sum(CAST(pm AS DECIMAL(24, 6))) / count(pm), 2) AS pm25_mean, sround(max(pm), 2) AS pm25_max, CAST(trunc(max(AQI)) AS INTEGER) AS aqi
FROM x GROUP BY location_id, date""", ["readings"])
def q_ag05(spark, d):
    """AG-05 (+MA-02): observations -> daily PM2.5 mean / max (2 dp) and max AQI."""
    obs = LD.parse_observations(payloads(spark, d), "obs_json", keep=["location_id", "date"])
    return LD.daily_observations(obs, ["location_id", "date"])


SENSOR_SQL = """
sr AS (SELECT location_id, date, pm AS pm_60m, CAST(k AS DOUBLE) AS pm_24h FROM pl
       UNION ALL SELECT location_id, date, CAST(k AS DOUBLE), pm FROM pl)"""


@query("src_09_ag_07_sensor_daily", "WITH " + PAYLOAD_SQL + "," + SENSOR_SQL + f""",
a AS (SELECT location_id, date, coalesce(sum(CAST(pm_24h AS DECIMAL(24, 6))) / count(pm_24h),
                                         sum(CAST(pm_60m AS DECIMAL(24, 6))) / count(pm_60m)) AS m, coalesce(max(pm_24h), max(pm_60m)) AS x
      FROM sr GROUP BY location_id, date)
SELECT location_id, date, sround(m, 2) AS pm25_mean, sround(x, 2) AS pm25_max,
       {_pm_aqi_sql('m')} AS aqi
FROM a""", ["readings"])
def q_src09(spark, d):
    """SRC-09 (positional last-two fields, short rows skipped) + AG-07 + MA-03: sensor daily PM and AQI."""
    rows = LD.parse_sensor_rows(payloads(spark, d), "sensor_json", keep=["location_id", "date"])
    return LD.daily_sensors(rows, ["location_id", "date"])


LEVEL_WORDS = ["HEAVY", "Low", "medium", "NONE", "Extremely Heavy"]


def report_pages(spark, d):
    """Landed report pages: each page plus a pollen section for 3 of 4 pages."""
    p = T.raw(spark, d, "pages")
    pid = F.col("page_id")
    words = F.array(*[F.lit(w) for w in LEVEL_WORDS])
    w1 = F.element_at(words, (F.pmod(pid, F.lit(5)) + 1).cast("int"))
    w2 = F.element_at(words, (F.pmod(pid + 2, F.lit(5)) + 1).cast("int"))
    extra = F.concat(F.lit(' <a href="/services/pollen-mold/pollen-mold-count-'), pid.cast("string"),
                     F.lit('">report</a><p>TREE POLLEN'), w1, F.lit("1,832</p><p>GRASS POLLEN "), w2, F.lit(" 3</p>"))
    return p.select("page_id", F.concat(F.col("html"), F.when(pid % 4 == 0, F.lit("")).otherwise(extra)).alias("html"))


@query("src_10_ma_17_report_levels", """
WITH p AS (SELECT page_id, html || CASE WHEN page_id % 4 = 0 THEN '' ELSE
  ' <a href="/services/pollen-mold/pollen-mold-count-' || CAST(page_id AS VARCHAR) || '">report</a><p>TREE POLLEN'
  || (['HEAVY', 'Low', 'medium', 'NONE', 'Extremely Heavy'])[page_id % 5 + 1] || '1,832</p><p>GRASS POLLEN '
  || (['HEAVY', 'Low', 'medium', 'NONE', 'Extremely Heavy'])[(page_id + 2) % 5 + 1] || ' 3</p>' END AS html FROM pages),
m AS (SELECT page_id,
  nullif(regexp_extract(html, '(?i)href=["'']([^"'']*pollen-mold-count-[^"'']+)["'']', 1), '') AS report_link,
  replace(lower(wtrim(regexp_extract(html, '(?i)TREE\\s*POLLEN\\s*(HEAVY|LOW|MEDIUM|NONE|Extremely\\s*Heavy)\\s*[\\d,]*', 1))), ' ', '') AS tw,
  replace(lower(wtrim(regexp_extract(html, '(?i)GRASS\\s*POLLEN\\s*(HEAVY|LOW|MEDIUM|NONE|Extremely\\s*Heavy)\\s*[\\d,]*', 1))), ' ', '') AS gw,
  replace(lower(wtrim(regexp_extract(html, '(?i)WEED\\s*POLLEN\\s*(HEAVY|LOW|MEDIUM|NONE|Extremely\\s*Heavy)\\s*[\\d,]*', 1))), ' ', '') AS ww
  FROM p),
i AS (SELECT page_id, report_link,
  CASE tw WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'heavy' THEN 3 WHEN 'extremelyheavy' THEN 4 END AS tree_index,
  CASE gw WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'heavy' THEN 3 WHEN 'extremelyheavy' THEN 4 END AS grass_index,
  CASE ww WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'heavy' THEN 3 WHEN 'extremelyheavy' THEN 4 END AS weed_index
  FROM m)
SELECT * FROM i WHERE tree_index IS NOT NULL OR grass_index IS NOT NULL OR weed_index IS NOT NULL""", [])
def q_src10(spark, d):
    """SRC-10 + MA-17: report link and level words -> pollen indices; pages without levels give no row."""
    return LD.extract_levels(report_pages(spark, d), "html", keep=["page_id"])
