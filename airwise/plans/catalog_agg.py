"""Queries: aggregations (AG-03 .. AG-24) and the EDA report (FE-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import strings as S
from airwise.operators import aggregates as AG
from airwise.operators import joins as J
from airwise.plans.catalog_env import PROBA_SQL, fe01_sql, lb01_sql
from airwise.operators import quantiles as Q
from airwise.plans.registry import query
from airwise.sources import tables as T


def _eda_frame(spark, d):
    """Check-ins left-joined to the env of their user's location - the EDA input."""
    c = T.checkins(spark, d).select("user_id", T.location_of("user_id").alias("location_id"), "date", "rescueUsed", "symptomScore")
    e = T.env_daily(spark, d).select("location_id", "date", "PM2_5_mean", "AQI", "humidity", "pollen_weed", "rain")
    return c.join(e, ["location_id", "date"], "left").drop("location_id")


EDA_SQL = """
eda AS (SELECT c.user_id, c.date, c.rescueUsed, c.symptomScore, e.PM2_5_mean, e.AQI, e.humidity, e.pollen_weed, e.rain
        FROM checkins c LEFT JOIN env_daily e ON c.date = e.date AND e.location_id = CAST(c.user_id % 10 + 10 * (c.user_id // 150) AS VARCHAR))"""


def hourly_payload(spark, d, n_hours: int = 72):
    """Per-reading landed hourly payload: an array of n_hours values derived from
    the reading (value ramps by hour, every 11th slot missing).  Bounded per row."""
    r = T.readings(spark, d)
    arr = F.transform(F.sequence(F.lit(0), F.lit(n_hours - 1)),
                      lambda h: F.when(F.pmod(h + F.col("k"), F.lit(11)) == 0, F.lit(None).cast("double"))
                      .otherwise(F.col("pm") * (h + 1) / n_hours + F.col("k")))
    return r.select("event_id", "location_id", "ts", arr.alias("pm2_5"))


PAYLOAD_SQL = """
payload AS (SELECT event_id, location_id, ts,
  list_transform(range(72), lambda h: CASE WHEN (h + k) % 11 = 0 THEN NULL ELSE pm * (h + 1) / 72 + k END) AS pm2_5
  FROM readings)"""


@query("ag_03_chunk_means", "WITH " + PAYLOAD_SQL + """,
c AS (SELECT event_id, unnest([0, 1, 2]) AS chunk, pm2_5 FROM payload)
SELECT event_id, CAST(chunk AS INTEGER) AS chunk, list_avg(pm2_5[chunk * 24 + 1 : chunk * 24 + 24]) AS chunk_mean
FROM c""", ["readings"])
def q_ag03(spark, d):
    """AG-03: a 3-day hourly array split into 3 positional chunks, null-skipping mean of each (per row)."""
    p = hourly_payload(spark, d)
    return p.select("event_id", F.posexplode(AG.chunk_means("pm2_5", 3)).alias("chunk", "chunk_mean"))


@query("ag_04_daily_pollen", """
WITH h AS (SELECT location_id, ts,
  CASE WHEN kind = 'click' THEN pm END AS alder_pollen, CASE WHEN kind = 'view' THEN pm / 2 END AS birch_pollen,
  CASE WHEN kind = 'signup' THEN pm / 3 END AS olive_pollen, CASE WHEN kind = 'error' THEN pm END AS grass_pollen,
  CASE WHEN kind = 'purchase' THEN pm END AS mugwort_pollen, CASE WHEN k > 90 THEN CAST(k AS DOUBLE) END AS ragweed_pollen
  FROM readings)
SELECT location_id, CAST(ts AS DATE) AS date,
       max(greatest(alder_pollen, birch_pollen, olive_pollen)) AS pollen_tree,
       max(grass_pollen) AS pollen_grass, max(greatest(mugwort_pollen, ragweed_pollen)) AS pollen_weed
FROM h GROUP BY location_id, CAST(ts AS DATE)""", ["readings"])
def q_ag04(spark, d):
    """AG-04: hourly species -> per-hour group max -> per-day max (all-null stays null)."""
    r = T.readings(spark, d)
    k = F.col("kind")
    h = r.select("location_id", F.col("ts").alias("time"),
                 F.when(k == "click", F.col("pm")).alias("alder_pollen"),
                 F.when(k == "view", F.col("pm") / 2).alias("birch_pollen"),
                 F.when(k == "signup", F.col("pm") / 3).alias("olive_pollen"),
                 F.when(k == "error", F.col("pm")).alias("grass_pollen"),
                 F.when(k == "purchase", F.col("pm")).alias("mugwort_pollen"),
                 F.when(F.col("k") > 90, F.col("k").cast("double")).alias("ragweed_pollen"))
    return AG.daily_pollen(h)


@query("ag_07_daily_sensors", """
WITH s AS (SELECT location_id, date, CASE WHEN kind <> 'view' THEN pm END AS pm_24h, CAST(k AS DOUBLE) AS pm_60m FROM readings)
SELECT location_id, date, coalesce(avg(pm_24h), avg(pm_60m)) AS pm25_mean, coalesce(max(pm_24h), max(pm_60m)) AS pm25_max
FROM s GROUP BY location_id, date""", ["readings"])
def q_ag07(spark, d):
    """AG-07: sensor rows -> daily mean / max of 24 h values, else of 60 min values."""
    r = T.readings(spark, d)
    s = r.select("location_id", "date", F.when(F.col("kind") != "view", F.col("pm")).alias("pm_24h"),
                 F.col("k").cast("double").alias("pm_60m"))
    return AG.daily_sensors(s)


@query("ag_08_value_counts", "WITH " + EDA_SQL + """
SELECT rescueUsed, count(*) AS count FROM eda GROUP BY rescueUsed""", ["checkins", "env_daily"])
def q_ag08(spark, d):
    """AG-08: value counts of the outcome."""
    return AG.value_counts(_eda_frame(spark, d), "rescueUsed")


@query("ag_09_describe", "WITH " + EDA_SQL + """
SELECT count(symptomScore) AS count, avg(symptomScore) AS mean, stddev_samp(symptomScore) AS std, min(symptomScore) AS min,
       quantile_cont(symptomScore, 0.25) AS q25, quantile_cont(symptomScore, 0.5) AS q50,
       quantile_cont(symptomScore, 0.75) AS q75, max(symptomScore) AS max FROM eda""", ["checkins", "env_daily"])
def q_ag09(spark, d):
    """AG-09: describe (count, mean, sample std, min, quartiles, max)."""
    return AG.describe_col(_eda_frame(spark, d), "symptomScore")


@query("ag_10_null_counts", """
WITH n AS (SELECT 'location_id' AS "column", count(*) FILTER (WHERE location_id IS NULL) AS nulls FROM daily_big
      UNION ALL SELECT 'zip_code', count(*) FILTER (WHERE zip_code IS NULL) FROM daily_big
      UNION ALL SELECT 'PM2_5_mean', count(*) FILTER (WHERE PM2_5_mean IS NULL) FROM daily_big
      UNION ALL SELECT 'pollen_tree', count(*) FILTER (WHERE pollen_tree IS NULL) FROM daily_big
      UNION ALL SELECT 'pollen_grass', count(*) FILTER (WHERE pollen_grass IS NULL) FROM daily_big
      UNION ALL SELECT 'pollen_weed', count(*) FILTER (WHERE pollen_weed IS NULL) FROM daily_big)
SELECT "column", nulls FROM n WHERE nulls > 0""", ["daily_big"])
def q_ag10(spark, d):
    """AG-10: null count per column (only > 0) over the whole table, one aggregate + unpivot."""
    b = T.daily_big(spark, d).select("location_id", "zip_code", "PM2_5_mean", "pollen_tree", "pollen_grass",
                                     "pollen_weed")
    return AG.null_counts(b)


@query("ag_11_correlations", "WITH " + EDA_SQL + """
SELECT * FROM (VALUES ('PM2_5_mean', (SELECT corr(PM2_5_mean, symptomScore) FROM eda)),
                      ('AQI', (SELECT corr(AQI, symptomScore) FROM eda)),
                      ('humidity', (SELECT corr(humidity, symptomScore) FROM eda)),
                      ('pollen_weed', (SELECT corr(pollen_weed, symptomScore) FROM eda)),
                      ('rain', (SELECT corr(rain, symptomScore) FROM eda))) AS t("column", r)""",
       ["checkins", "env_daily"])
def q_ag11(spark, d):
    """AG-11: Pearson r of each numeric column with the outcome, pairwise complete, by |r| desc."""
    return AG.correlations(_eda_frame(spark, d), "symptomScore", ["PM2_5_mean", "AQI", "humidity", "pollen_weed", "rain"])


@query("ag_12_14_15_profile_counts", """
SELECT count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date, count(DISTINCT location_id) AS n_location_id,
       count(DISTINCT season) AS n_season FROM daily_big""", ["daily_big"])
def q_ag12(spark, d):
    """AG-12 (count), AG-14 (date range), AG-15 (exact distinct counts) in one aggregate."""
    df = T.daily_big(spark, d)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                  F.count_distinct("location_id").alias("n_location_id"), F.count_distinct("season").alias("n_season"))


@query("ag_13_total_checkins", """
SELECT CAST(count(*) AS BIGINT) AS total_checkins FROM checkins""", ["checkins"])
def q_ag13(spark, d):
    """AG-13: total nested check-ins over all users (null array = 0)."""
    from airwise.operators import sinks as SK
    nested = SK.nest_checkins(T.users(spark, d).select("user_id"), T.checkins(spark, d))
    return AG.total_checkins(nested)


@query("ag_16_18_rates", """
SELECT quantile_cont(p, 0.5) AS p_median, quantile_cont(p, 0.9) AS p90, avg(CAST(y AS DOUBLE)) AS positive_rate
FROM scored""", ["scored"])
def q_ag16(spark, d):
    """AG-16 (interpolated quantiles) and AG-18 (positive rate)."""
    s = T.scored(spark, d)
    q = Q.exact_quantiles(s, "p", [0.5, 0.9])
    return s.agg(F.avg(F.col("y").cast("double")).alias("positive_rate")).select(
        q.select("q0").scalar().alias("p_median"), q.select("q1").scalar().alias("p90"), "positive_rate")


@query("ag_19_week_summary", """
WITH x AS (SELECT location_id, date, [PM2_5_mean, PM2_5_max / 2, AQI / 4] AS probs FROM env_daily
           WHERE date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'),
c AS (SELECT location_id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS cls FROM x)
SELECT location_id, avg(cls) AS mean_level, min(cls) AS min_level, max(cls) AS max_level FROM c GROUP BY location_id""",
       ["env_daily"])
def q_ag19(spark, d):
    """AG-19 (+AJ-05): weekly summary of the argmax class per location."""
    e = T.env_daily(spark, d).where(F.col("date").between("2024-01-24", "2024-01-30"))
    x = e.select("location_id", F.array("PM2_5_mean", F.col("PM2_5_max") / 2, F.col("AQI") / 4).alias("probs"))
    return AG.week_summary(x, "probs", ["location_id"])


@query("ag_20_score_summary", """
SELECT lang, min(greatest(1.0::DOUBLE, least(5.0::DOUBLE, 10 * p))) AS score_min,
       max(greatest(1.0::DOUBLE, least(5.0::DOUBLE, 10 * p))) AS score_max,
       avg(greatest(1.0::DOUBLE, least(5.0::DOUBLE, 10 * p))) AS score_mean
FROM scored GROUP BY lang""", ["scored"])
def q_ag20(spark, d):
    """AG-20: score min / max / mean after clipping to 1..5."""
    s = T.scored(spark, d).withColumn("score", F.col("p") * 10)
    return AG.score_summary(s, "score", by=["lang"])


@query("ag_21_22_fold_and_split_counts", """
WITH f AS (SELECT doc_id, y, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM scored),
s AS (SELECT *, CASE WHEN i < greatest(1, least(n - 1, floor(n * 0.8))) THEN 'train' ELSE 'test' END AS split FROM f)
SELECT split, y, count(*) AS n FROM s GROUP BY split, y""", ["scored"])
def q_ag22(spark, d):
    """AG-22: class distribution per chronological split (WN-13 + groupBy)."""
    from airwise.operators import windows as W
    s = W.time_split(T.scored(spark, d).select("doc_id", "y"), 0.8, [F.col("doc_id")])
    return AG.split_counts(s, "split", "y")


@query("ag_21_fold_summary", """
WITH r AS (SELECT y, CAST(p >= 0.1 AS INTEGER) AS pred, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM scored),
k AS (SELECT *, greatest(2, least(5, n // 50)) AS k FROM r), f AS (SELECT *, n // (k + 1) AS t FROM k),
b AS (SELECT y, pred, (i - (n - k * t)) // t + 1 AS fold FROM f WHERE t > 0 AND i >= n - k * t),
m AS (SELECT fold, coalesce(count(*) FILTER (WHERE y = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE pred = 1), 0), 0.0) AS precision,
             coalesce(count(*) FILTER (WHERE y = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 0.0) AS recall FROM b GROUP BY fold)
SELECT avg(precision) AS precision_mean, stddev_pop(precision) AS precision_std,
       avg(recall) AS recall_mean, stddev_pop(recall) AS recall_std FROM m""", ["scored"])
def q_ag21(spark, d):
    """AG-21 over the test blocks of expanding chronological folds (WN-14, the personalised rule): precision and
    recall of a fixed score per fold, then mean and population std."""
    from airwise.operators import windows as W
    s = W.expanding_folds(T.scored(spark, d).select("doc_id", "y", "p"), "personal", [F.col("doc_id")]).where("test_fold IS NOT NULL")
    hit, pred = F.count_if((F.col("y") == 1) & (F.col("p") >= 0.1)), F.col("p") >= 0.1
    m = s.groupBy("test_fold").agg(
        F.coalesce(F.try_divide(hit, F.count_if(pred)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, F.count_if(F.col("y") == 1)), F.lit(0.0)).alias("recall"))
    return AG.fold_summary(m, ["precision", "recall"])


@query("ag_23_alert_summary", f"""
WITH {fe01_sql('env_daily')},
{lb01_sql()},
risk AS (SELECT location_id, CASE WHEN {PROBA_SQL} >= 0.5
              THEN 'high' ELSE 'other' END AS level FROM lb WHERE date = DATE '2024-01-27'),
a AS (SELECT u.user_id, r.level = 'high' AND coalesce(length(wtrim(u.email)) > 0, false) AS sent
      FROM users u JOIN risk r ON r.location_id = coalesce(nullif(wtrim(u.location), ''), '0'))
SELECT count(*) AS checked, count(*) FILTER (WHERE sent) AS sent, count(*) FILTER (WHERE NOT sent) AS skipped FROM a""",
       ["env_daily", "users"])
def q_ag23(spark, d):
    """AG-23: alert run summary (users checked, sent, skipped) over the JN-14 list."""
    from airwise.plans.catalog_joins import alert_list
    a = alert_list(spark, d)
    sent = (F.col("level") == "high") & F.coalesce(F.length(S.ws_trim("email")) > 0, F.lit(False))
    return AG.alert_summary(a.withColumn("sent", sent))


def _jsn(x: str) -> str:
    return f"coalesce(regexp_replace(CAST({x} AS VARCHAR), '\\.0$', ''), '—')"


AG24_PROBA = PROBA_SQL.replace("pollen_total", "(coalesce(pollen_tree, 0) + coalesce(pollen_grass, 0) + coalesce(pollen_weed, 0))")


@query("ag_24_str_12_week_digest", f"""
WITH e AS (SELECT location_id, date, sround(AQI, 2) AS AQI, sround(PM2_5_mean, 2) AS PM2_5_mean,
                  sround(temp_min, 2) AS temp_min, sround(temp_max, 2) AS temp_max, sround(humidity, 2) AS humidity,
                  sround(pollen_tree, 2) AS pollen_tree, sround(pollen_grass, 2) AS pollen_grass,
                  sround(pollen_weed, 2) AS pollen_weed, day_of_week
           FROM env_daily WHERE date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'),
p AS (SELECT *, {AG24_PROBA} AS p FROM e),
x AS (SELECT location_id, date,
  '- ' || strftime(date, '%Y-%m-%d') || ' (' || day_of_week || '): Risk '
  || CASE WHEN p < 0.2 THEN 'Low' WHEN p < 0.5 THEN 'Moderate' ELSE 'High' END
  || ' (score ' || {_jsn("sround(CASE WHEN p < 0.2 THEN 1 + p * 5 WHEN p < 0.5 THEN 2 + (p - 0.2::DOUBLE) * 10 ELSE 4 + (p - 0.5::DOUBLE) * 2 END, 1)")}
  || '). Factors: ' || coalesce(nullif(concat_ws(', ', CASE WHEN AQI >= 101 THEN 'Poor Air Quality' END,
        CASE WHEN PM2_5_mean >= 35 THEN 'High PM2.5' END,
        CASE WHEN coalesce(pollen_tree, 0) + coalesce(pollen_grass, 0) + coalesce(pollen_weed, 0) >= 8 THEN 'High Pollen' END,
        CASE WHEN temp_min < 5 THEN 'Cold Temperature' END, CASE WHEN humidity >= 80 THEN 'High Humidity' END), ''),
        'Environmental conditions')
  || '. AQI: ' || {_jsn("AQI")} || ', PM2.5 mean: ' || {_jsn("PM2_5_mean")} || ', temp: ' || {_jsn("temp_min")}
  || '–' || {_jsn("temp_max")} || ' °C, humidity: ' || {_jsn("humidity")} || '%. Pollen: tree ' || {_jsn("pollen_tree")}
  || ', grass ' || {_jsn("pollen_grass")} || ', weed ' || {_jsn("pollen_weed")} || '.' AS line FROM p)
SELECT location_id, string_agg(line, chr(10) ORDER BY date) AS digest FROM x GROUP BY location_id""", ["env_daily"])
def q_ag24(spark, d):
    """AG-24 + STR-12: ordered per-location week digest of the assistant context lines
    (risk, factor labels, measures with '—' for missing parts); groups hold 7 rows."""
    from airwise.functions import arrays as A
    from airwise.functions import mathx as M
    e = T.env_daily(spark, d).where(F.col("date").between("2024-01-24", "2024-01-30"))
    meas = ["AQI", "PM2_5_mean", "temp_min", "temp_max", "humidity", "pollen_tree", "pollen_grass", "pollen_weed"]
    e = e.select("location_id", "date", "day_of_week", *[F.round(c, 2).alias(c) for c in meas])  # stored at 2 dp
    pt = M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed")
    p = M.rule_probability("AQI", "PM2_5_mean", pt)
    factors = F.transform(A.risk_factors("AQI", "PM2_5_mean", pt, "temp_min", "humidity"), lambda f: f["label"])
    line = S.day_line(F.date_format("date", "yyyy-MM-dd"), "day_of_week", M.level_label(M.proba_to_level(p)),
                      M.proba_to_score(p), factors, "AQI", "PM2_5_mean", "temp_min", "temp_max", "humidity",
                      "pollen_tree", "pollen_grass", "pollen_weed")
    return AG.week_digest(e, "location_id", line)


@query("fe_10_eda_report_lines", "WITH " + EDA_SQL + """,
m AS (SELECT 0 AS section, '' AS rank, 'rows: ' || count(*) AS line FROM eda
  UNION ALL SELECT 1, CAST(rescueUsed AS VARCHAR), 'count rescueUsed=' || CAST(rescueUsed AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) FROM eda GROUP BY rescueUsed
  UNION ALL SELECT 2, stat, 'describe symptomScore ' || stat || ': ' || printf('%.3f', value) FROM (
    SELECT unnest(['mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) AS stat,
           unnest([avg(symptomScore), stddev_samp(symptomScore), min(symptomScore), quantile_cont(symptomScore, 0.25), quantile_cont(symptomScore, 0.5),
                   quantile_cont(symptomScore, 0.75), max(symptomScore)]) AS value FROM eda)
  UNION ALL SELECT 3, c, 'missing ' || c || ': ' || CAST(n AS VARCHAR) FROM (
    SELECT unnest(['user_id', 'date', 'rescueUsed', 'symptomScore', 'PM2_5_mean', 'AQI', 'humidity', 'pollen_weed', 'rain']) AS c,
           unnest([count(*) - count(user_id), count(*) - count(date), count(*) - count(rescueUsed), count(*) - count(symptomScore), count(*) - count(PM2_5_mean),
                   count(*) - count(AQI), count(*) - count(humidity), count(*) - count(pollen_weed), count(*) - count(rain)]) AS n FROM eda) WHERE n > 0
  UNION ALL SELECT 4, printf('%.9f %s', 1 - abs(r), c), 'correlation symptomScore ' || c || ': ' || printf('%.3f', r) FROM (
    SELECT unnest(['PM2_5_mean', 'AQI', 'humidity', 'pollen_weed', 'rain']) AS c,
           unnest([corr(PM2_5_mean, symptomScore), corr(AQI, symptomScore), corr(humidity, symptomScore), corr(pollen_weed, symptomScore), corr(rain, symptomScore)]) AS r
    FROM eda) WHERE r IS NOT NULL)
SELECT row_number() OVER (ORDER BY section, rank) AS line_no, line FROM m""", ["checkins", "env_daily"])
def q_fe10(spark, d):
    """FE-10: the whole report (row count, AG-08, AG-09, AG-10, AG-11) in a fixed order, written with SNK-11 and
    read back."""
    from airwise.operators import sinks as SK
    from airwise.operators import windows as W
    from airwise.plans.eda import full_report
    lines = full_report(_eda_frame(spark, d), ["PM2_5_mean", "AQI", "humidity", "pollen_weed", "rain"])
    lines = W.row_index(lines, [F.col("section"), F.col("rank")], "i").select((F.col("i") + 1).alias("line_no"), F.col("line").alias("value"))
    path = SK.write_report(lines, SK.scratch_path(spark, "eda-report"))
    return SK.read_report(spark, path).select("line_no", F.col("value").alias("line"))
