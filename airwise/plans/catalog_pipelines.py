"""Queries: end-to-end pipelines (FE-08, FE-09), landed-file round trips (SRC-04, SRC-05),
the short-history fallback (FLT-05) and demo labels (LB-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.functions import arrays as A
from airwise.functions import labels as L
from airwise.functions import mathx as M
from airwise.operators import joins as J
from airwise.operators import filters as FLT
from airwise.operators import models as MD
from airwise.operators import projections as P
from airwise.operators import sets as ST
from airwise.operators import sinks as SK
from airwise.operators import sorts as SL
from airwise.plans import features as FE
from airwise.plans.catalog_ml import FE07_BASE
from airwise.plans.catalog_env import PROBA_SQL, score_sql
from airwise.plans.registry import query
from airwise.session import cut_lineage
from airwise.sources import scans as SC
from airwise.sources import tables as T


@query("src_04_prj_08_checkins_json_roundtrip", """
SELECT coalesce(CASE WHEN day(date) % 3 = 0 THEN NULL ELSE strftime(date, '%Y-%m-%d') END,
                strftime(CAST(date AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d')) AS date,
       CAST(user_id AS VARCHAR) AS userId, rescueUsed, symptomScore FROM checkins""", ["checkins"])
def q_src04(spark, d):
    """SRC-04 (+SNK-02, PRJ-08): older check-in layout landed as JSON lines, read back
    with an explicit schema and turned into dated rows."""
    c = T.checkins(spark, d)
    old = c.select(F.col("user_id").cast("string").alias("userId"),
                   F.when(F.dayofmonth("date") % 3 == 0, F.lit(None).cast("string"))
                    .otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
                   (F.col("date").cast("timestamp") + F.expr("INTERVAL 9 HOURS")).alias("updatedAt"),
                   "rescueUsed", "symptomScore")
    path = SK.write_json(old, SK.scratch_path(spark, "checkins-json"))
    return P.checkin_rows(SC.read_checkins(spark, path))


@query("src_04_env_docs_roundtrip", """
SELECT strftime(date, '%Y-%m-%d') AS date, printf('%.4f_%.4f', latitude, longitude) AS locationKey,
       PM2_5_mean AS pm25_mean, CAST(trunc(AQI) AS INTEGER) AS aqi, humidity AS humidity_mean,
       CASE WHEN pollen_tree IS NOT NULL OR pollen_grass IS NOT NULL THEN pollen_weed END AS weed_index,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week_num
FROM env_daily""", ["env_daily"])
def q_src04b(spark, d):
    """SRC-04 (nested env documents written as parquet, read back) + PRJ-01 (flatten)."""
    docs = P.nest_env(T.env_daily(spark, d))
    path = SK.scratch_path(spark, "env-docs")
    docs.write.mode("overwrite").parquet(path)
    flat = P.flatten_env(SC.read_env_docs(spark, path))
    return flat.select("date", "locationKey", "pm25_mean", "aqi", "humidity_mean", "weed_index", "day_of_week_num")


TRAINING_SCHEMA = ("locationid string, date date, PM2_5_mean double, temp_min double, "
                   "google_trends_allergy double, flare_day int, risk int")


@query("src_05_training_csv_roundtrip", "WITH " + FE07_BASE + """,
f AS (SELECT *, coalesce(last_value(n_orders IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(n_orders IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS tv
      FROM ds),
q AS (SELECT quantile_cont(tv, [0.2, 0.4, 0.6, 0.8]) AS edges FROM f)
SELECT location_id AS locationid, date, PM2_5_mean,
       CAST(1 + (tv > edges[1])::INTEGER + (tv > edges[2])::INTEGER + (tv > edges[3])::INTEGER + (tv > edges[4])::INTEGER AS INTEGER) AS target_value,
       'risk' AS target
FROM f, q""", ["daily_big", "trends"])
def q_src05(spark, d):
    """SRC-05 (+SNK-01): the FE-07 dataset written as CSV with header, read back with a
    schema, target detected (risk, else flare_day)."""
    from airwise.plans.catalog_ml import q_fe07
    ds = q_fe07(spark, d)
    path = SK.write_csv(ds.select(*[c.split(" ")[0] for c in TRAINING_SCHEMA.split(", ")]),
                        SK.scratch_path(spark, "training-csv"))
    df, target = SC.read_training_csv(spark, path, TRAINING_SCHEMA)
    return df.select("locationid", "date", "PM2_5_mean", F.col(target).alias("target_value"),
                     F.lit(target).alias("target"))


@query("flt_05_short_history_fallback", """
WITH f AS (SELECT *, CASE WHEN location_id = '1' AND day(date) > 5 THEN NULL ELSE location_id END AS loc,
                  CASE WHEN location_id = '2' THEN NULL ELSE AQI END AS aqi2 FROM env_daily),
b AS (SELECT loc AS location_id, date, PM2_5_mean, PM2_5_max, aqi2 AS AQI, temp_min, temp_max, humidity, wind, pressure, rain,
        coalesce(pollen_tree, 0) AS pollen_tree, coalesce(pollen_grass, 0) AS pollen_grass, coalesce(pollen_weed, 0) AS pollen_weed,
        CAST(pollen_tree IS NULL AS INTEGER) AS pollen_tree_missing, temp_max - temp_min AS temp_range, PM2_5_max - PM2_5_mean AS pm_spike,
        humidity * (coalesce(PM2_5_mean, 0) + 1e-6) AS humid_x_pm, row_number() OVER (PARTITION BY loc ORDER BY date) AS i,
        count(*) OVER (PARTITION BY loc) AS n FROM f WHERE loc IS NOT NULL),
g AS (SELECT *, (PM2_5_mean IS NOT NULL AND PM2_5_max IS NOT NULL AND AQI IS NOT NULL AND temp_min IS NOT NULL AND temp_max IS NOT NULL
        AND humidity IS NOT NULL AND wind IS NOT NULL AND pressure IS NOT NULL AND rain IS NOT NULL) AS ok FROM b),
h AS (SELECT *, ok AND i >= 7 AND bool_and(ok) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS whole FROM g),
r AS (SELECT *, bool_or(whole) OVER (PARTITION BY location_id) AS full_history FROM h)
SELECT location_id, date, coalesce(AQI, 0) AS AQI, temp_range, pm_spike, humid_x_pm, pollen_tree_missing, pollen_tree, full_history
FROM r WHERE whole OR NOT full_history""", ["env_daily"])
def q_flt05(spark, d):
    """FLT-05 (+FE-02, MA-13/14), per series: in the fixture location 1 has five days only and location 2 no
    AQI at all, so both fall back to their un-lagged features; the others keep their full rows."""
    env = T.env_daily(spark, d).where(~((F.col("location_id") == "1") & (F.dayofmonth("date") > 5))) \
        .withColumn("AQI", F.when(F.col("location_id") != "2", F.col("AQI")))
    out = FE.flare_features_or_fallback(env)
    return out.select("location_id", "date", "AQI", "temp_range", "pm_spike", "humid_x_pm", "pollen_tree_missing", "pollen_tree", "full_history")


@query("lb_05_demo_next_day_labels", """
SELECT location_id, date, CAST(coalesce(lead(AQI) OVER w > 50, false) OR coalesce(lead(PM2_5_mean) OVER w > 15, false) AS INTEGER) AS flare
FROM env_daily WINDOW w AS (PARTITION BY location_id ORDER BY date)""", ["env_daily"])
def q_lb05(spark, d):
    """LB-05: next-day demo label (last day 0); a one-class result would flip half the rows."""
    return L.demo_next_day(T.env_daily(spark, d).select("location_id", "date", "AQI", "PM2_5_mean")) \
        .select("location_id", "date", "flare")


@query("lb_05_demo_one_class", """
WITH r AS (SELECT location_id, date, row_number() OVER (ORDER BY md5('7:' || location_id || ':' || CAST(date AS VARCHAR)), location_id, date) AS i,
                  count(*) OVER () AS n FROM daily_big)
SELECT location_id, date, CAST(i <= greatest(1, n // 2) AS INTEGER) AS flare FROM r""", ["daily_big"])
def q_lb05b(spark, d):
    """LB-05 on clean air everywhere (one class): exactly half of the rows are flipped."""
    clean = T.daily_big(spark, d).select("location_id", "date", F.lit(20.0).alias("AQI"), F.lit(5.0).alias("PM2_5_mean"))
    return L.demo_next_day(clean).select("location_id", "date", "flare")


WEEK_SQL = f"""
WITH locs AS (SELECT DISTINCT location_id FROM env_daily),
wanted AS (SELECT location_id, CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date FROM locs),
s AS (SELECT location_id, date, ((date_diff('day', DATE '0001-01-01', date) + 1) % 7) / 7.0::DOUBLE AS j FROM wanted),
x AS (SELECT w.location_id, w.date, e.location_id IS NOT NULL AS from_store,
        CASE WHEN e.location_id IS NOT NULL THEN e.AQI ELSE CAST(40 + floor(30 * s.j) AS DOUBLE) END AS AQI,
        CASE WHEN e.location_id IS NOT NULL THEN e.PM2_5_mean ELSE 10.0 + 8 * s.j END AS PM2_5_mean,
        CASE WHEN e.location_id IS NOT NULL THEN e.temp_min ELSE 10.0 + 3 * s.j END AS temp_min,
        CASE WHEN e.location_id IS NOT NULL THEN e.humidity ELSE 55.0 + 20 * s.j END AS humidity,
        CASE WHEN e.location_id IS NOT NULL THEN coalesce(e.pollen_tree, 0) + coalesce(e.pollen_grass, 0) + coalesce(e.pollen_weed, 0)
             ELSE (2.0 + 2 * s.j) + (1.0 + s.j) + (0.5 + s.j) END AS pollen_total
      FROM wanted w LEFT JOIN env_daily e ON e.location_id = w.location_id AND e.date = w.date
      LEFT JOIN s ON s.location_id = w.location_id AND s.date = w.date)
SELECT location_id, strftime(date, '%Y-%m-%d') AS date, from_store, {score_sql(PROBA_SQL)} AS score,
       CASE WHEN {PROBA_SQL} < 0.2 THEN 'Low' WHEN {PROBA_SQL} < 0.5 THEN 'Moderate' ELSE 'High' END AS label,
       coalesce(nullif(concat_ws(',', CASE WHEN AQI >= 101 THEN 'air' END, CASE WHEN PM2_5_mean >= 35 THEN 'pm25' END,
                CASE WHEN pollen_total >= 8 THEN 'pollen' END, CASE WHEN temp_min < 5 THEN 'temp' END,
                CASE WHEN humidity >= 80 THEN 'humidity' END), ''), 'general') AS factors
FROM x"""


def week_records(spark, d, start: str = "2024-01-27", days: int = 7):
    """FE-09 core: locations x next days; stored row else generated row; rule probability;
    {date, risk, activeRiskFactors, daily} record."""
    env = T.env_daily(spark, d)
    env = env.select("location_id", "date", "AQI", "PM2_5_mean", "temp_min", "humidity",
                     M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed").alias("pollen_total"))
    s = F.lit(start).cast("date")
    wanted = ST.expand_dates(env.select("location_id").distinct(), s, F.date_add(s, days - 1)).drop("day_idx")
    synth = ST.synthetic_env(wanted, "risk").select(
        "location_id", "date", "AQI", "PM2_5_mean", "temp_min", "humidity",
        (F.col("pollen_tree") + F.col("pollen_grass") + F.col("pollen_weed")).alias("pollen_total"))
    rows = J.match_or_synthetic(wanted, env, synth)
    p = M.rule_probability("AQI", "PM2_5_mean", "pollen_total")
    factors = A.risk_factors("AQI", "PM2_5_mean", "pollen_total", "temp_min", "humidity")
    rec = P.risk_record(F.date_format("date", "yyyy-MM-dd"), p, factors,
                        F.struct("AQI", "PM2_5_mean", "temp_min", "humidity", "pollen_total"))
    return rows.select("location_id", "from_store", rec.alias("record"))


@query("fe_09_week_forecast_records", WEEK_SQL, ["env_daily"])
def q_fe09(spark, d):
    """FE-09: environmental 7-day forecast per location as one plan (ST-05 spine, JN-13 with
    ST-04 rows, MA-08 -> MA-04 score, AJ-01 factors, PRJ-14 record, AJ-04 flattening)."""
    r = week_records(spark, d)
    return r.select("location_id", F.col("record.date").alias("date"), "from_store",
                    F.col("record.risk.score").alias("score"), F.col("record.risk.label").alias("label"),
                    A.factor_ids(F.col("record.activeRiskFactors")).alias("factors"))


# AQI, PM, the pollen total and today's symptoms define the risk label, so they are no features of it.
PERSONAL_NUM = ["humidity", "wind", "temp_min", "temp_max", "pressure", "rain", "pm25_delta", "pm25_roll3_mean", "pm25_roll7_mean",
                "aqi_roll3_mean", "aqi_roll7_mean", "pollen_total_lag1", "wheeze_lag1", "cough_lag1", "chestTightness_lag1",
                "exerciseMinutes_lag1", "symptom_score_lag1"]
PERSONAL_START, PERSONAL_DAYS = "2024-01-24", 7


def _personal_frame(spark, d, users):
    """Users x days with their location's env time features (FE-03) and symptom lags (FE-04), over the
    whole history: callers cut to a window after the lags."""
    env = T.env_daily(spark, d)
    u = users.withColumn("location_id", T.location_of("user_id"))
    ue = u.join(env, "location_id", "inner").drop("location_id")
    tf = FE.user_time_features(ue, "user_id")
    c = T.checkins(spark, d)
    j = J.join_checkins(tf, c)
    return FE.symptom_lags(j)


def personal_training(spark, d):
    """(frame with risk, history before the window with a validation mark): the mark takes a fifth of the rows
    by MD5 of user and day (early stopping), the order is chronological for the folds."""
    users = T.checkins(spark, d).select("user_id").distinct()
    frame = _personal_frame(spark, d, users)
    # the landed proxy's AQI is twice a day's largest index; halved it is on a daily scale (else every day is a risk)
    frame = frame.withColumn("risk", L.personal_risk("symptom_score", F.col("AQI") / 2, "PM2_5_mean", "pollen_total"))
    h = F.md5(F.concat_ws(":", F.lit("42"), F.col("user_id").cast("string"), F.col("date").cast("string")))
    hist = frame.where(F.col("date") < PERSONAL_START) \
        .withColumn("validation", F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 5 == 0)
    return users, frame, hist


def personal_gbt():
    """The personalised learner: boosted trees, depth 5, step 0.05, 200 rounds, early stopping on a fifth."""
    return MD.gbt("risk", max_depth=5, step=0.05, max_iter=200, validation_col="validation")


def personalized_flow(spark, d, cache, users, score):
    """FE-08 after training: the cache test (JN-09, all or nothing); on a hit the cached rows, else
    ``score(wanted)`` (user_id, date, score), the no-symptom override with env-only scores (AG-17, JN-11,
    MA-08) and the cache upsert (SNK-09).  Returns (rows, hit)."""
    from airwise.operators import aggregates as AG

    dates = SL.next_dates(T.env_daily(spark, d), PERSONAL_START, PERSONAL_DAYS)
    wanted = J.users_x_dates(users, [r[0] for r in dates.collect()])  # at most PERSONAL_DAYS dates
    if J.cache_is_complete(wanted, cache):
        return J.cached_rows(cache, users, dates), True
    pred = score(wanted).select("user_id", T.location_of("user_id").alias("location_id"), "date", "score")
    no_sym = AG.users_without_symptoms(T.checkins(spark, d).where(F.col("date") < PERSONAL_START))
    env_scores = T.env_daily(spark, d).select("location_id", "date", M.binary_score(M.rule_probability(
        "AQI", "PM2_5_mean", M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed"))).alias("score"))
    final = J.override_scores(pred, no_sym, env_scores, keys=["location_id", "date"]).drop("location_id")
    return SK.save_predictions(cache, final.withColumnRenamed("score", "risk"), "risk",
                               F.lit("2024-01-24 00:00:00").cast("timestamp")), False


def _shown(rows):
    return rows.select("user_id", "date", M.display_score("risk").alias("display_score"), M.display_level(M.display_score("risk")).alias("level"))


@query("fe_08_personalized_forecast")
def q_fe08(spark, d):
    """FE-08: personalised 7-day forecast with the trained model: boosted trees with early stopping on the
    history before the window (LB-02 label, PRJ-15 features, ML-01, ML-06, ML-16 bundle), then the
    flow with an empty cache and display scores (MA-05, MA-07, MA-19)."""
    users, frame, hist = personal_training(spark, d)
    num, _ = P.feature_columns(hist.select(*PERSONAL_NUM, "risk"), target="risk")
    FLT.assert_trainable(hist, "risk", min_rows=50, user="user_id")
    fill = MD.Imputer(hist, num)
    model = MD.make_pipeline(num, [], personal_gbt()).fit(cut_lineage(fill(hist.select(*num, "risk", "validation"))))
    path = MD.save_bundle(model, SK.scratch_path(spark, "personal-model"), num, "risk", "binary")
    model, meta = MD.load_bundle(path)

    def score(wanted):
        x = fill(frame.join(wanted, ["user_id", "date"], "left_semi"))
        x = P.align_features(x, meta["feature_cols"], keep=["user_id", "date"])
        return MD.score(model, x, ["user_id", "date"]).withColumn("score", M.binary_score("p"))

    cache = spark.createDataFrame([], "user_id long, date date, risk double, updated_at timestamp")
    return _shown(personalized_flow(spark, d, cache, users, score)[0])


def _rule_scores(spark, d):
    """A scorer without training, so the flow has a SQL twin: the rule probability of the user's location and
    day, raised by yesterday's symptoms."""
    users = T.checkins(spark, d).select("user_id").distinct()
    frame = _personal_frame(spark, d, users)

    def score(wanted):
        p = M.rule_probability("AQI", "PM2_5_mean", "pollen_total") + F.col("symptom_score_lag1") * 0.02
        return frame.join(wanted, ["user_id", "date"], "left_semi").select("user_id", "date", M.binary_score(p).alias("score"))

    return users, score


FE08_SQL = f"""
u AS (SELECT DISTINCT user_id FROM checkins),
days AS (SELECT date FROM (SELECT DISTINCT date FROM env_daily WHERE date >= DATE '2024-01-24') ORDER BY date LIMIT 7),
wanted AS (SELECT user_id, date FROM u, days),
full_cache AS (SELECT user_id, date, 1.0::DOUBLE + ((user_id + day(date)) % 5) * 0.75::DOUBLE AS risk, TIMESTAMP '2024-01-20 00:00:00' AS updated_at FROM wanted),
fr AS (SELECT u.user_id, e.date, e.location_id, e.AQI, e.PM2_5_mean,
         coalesce(e.pollen_tree, 0) + coalesce(e.pollen_grass, 0) + coalesce(e.pollen_weed, 0) AS pollen_total,
         coalesce(c.wheeze, 0) + coalesce(c.cough, 0) + coalesce(c.chestTightness, 0) AS sym
       FROM u JOIN env_daily e ON e.location_id = CAST(u.user_id % 10 + 10 * (u.user_id // 150) AS VARCHAR) LEFT JOIN checkins c ON c.user_id = u.user_id AND c.date = e.date),
lg AS (SELECT *, coalesce(lag(sym) OVER (PARTITION BY user_id ORDER BY date), 0) AS sym1 FROM fr),
ns AS (SELECT user_id, bool_and(wheeze = 0 AND cough = 0 AND chestTightness = 0) AS no_symptoms FROM checkins WHERE date < DATE '2024-01-24' GROUP BY user_id),
sc AS (SELECT l.user_id, l.date,
         sround(greatest(1.0, least(5.0, 1 + 4 * ({PROBA_SQL} + CASE WHEN coalesce(ns.no_symptoms, false) THEN 0 ELSE sym1 * 0.02::DOUBLE END))), 2) AS risk
       FROM lg l JOIN wanted w ON w.user_id = l.user_id AND w.date = l.date LEFT JOIN ns ON ns.user_id = l.user_id)"""


def _full_cache(users, dates):
    w = J.users_x_dates(users, dates)
    return w.select("user_id", "date", (1.0 + ((F.col("user_id") + F.dayofmonth("date")) % 5) * 0.75).alias("risk"),
                    F.lit("2024-01-20 00:00:00").cast("timestamp").alias("updated_at"))


def _window_dates(spark, d):
    return [r[0] for r in SL.next_dates(T.env_daily(spark, d), PERSONAL_START, PERSONAL_DAYS).collect()]


@query("fe_08_cache_hit", "WITH " + FE08_SQL + """
SELECT user_id, date, risk, updated_at FROM full_cache""", ["checkins", "env_daily"])
def q_fe08_hit(spark, d):
    """FE-08, cache complete: the cached rows come back and nothing is scored."""
    users, score = _rule_scores(spark, d)
    rows, hit = personalized_flow(spark, d, _full_cache(users, _window_dates(spark, d)), users, score)
    assert hit
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("fe_08_cache_one_pair_short", "WITH " + FE08_SQL + """
SELECT coalesce(s.user_id, c.user_id) AS user_id, coalesce(s.date, c.date) AS date, coalesce(s.risk, c.risk) AS risk,
       CASE WHEN s.user_id IS NOT NULL THEN TIMESTAMP '2024-01-24 00:00:00' ELSE c.updated_at END AS updated_at
FROM sc s FULL OUTER JOIN (SELECT * FROM full_cache WHERE NOT (user_id = (SELECT min(user_id) FROM u) AND date = (SELECT max(date) FROM days))) c
  ON c.user_id = s.user_id AND c.date = s.date""", ["checkins", "env_daily"])
def q_fe08_miss(spark, d):
    """FE-08, one pair missing: all pairs are scored (all or nothing), the no-symptom override applies and the
    saved table holds the new scores."""
    users, score = _rule_scores(spark, d)
    dates = _window_dates(spark, d)
    gap = users.agg(F.min("user_id")).scalar()
    cache = _full_cache(users, dates).where(~((F.col("user_id") == gap) & (F.col("date") == F.lit(max(dates)))))
    rows, hit = personalized_flow(spark, d, cache, users, score)
    assert not hit
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("fe_08_cross_validation")
def q_fe08_cv(spark, d):
    """The personalised trainer's report: expanding chronological folds (WN-14, min(5, n // 50)), the boosted
    trees fitted on each, AUC (ML-08), precision and recall (ML-11) of the test block, folds with one
    class skipped, and mean and population std over the folds (AG-21)."""
    from airwise.operators import aggregates as AG
    from airwise.operators import stats as STS
    from airwise.operators import windows as W

    _, _, hist = personal_training(spark, d)
    num, _ = P.feature_columns(hist.select(*PERSONAL_NUM, "risk"), target="risk")
    FLT.assert_trainable(hist, "risk", min_rows=50, user="user_id")
    folds = cut_lineage(W.expanding_folds(hist.select("user_id", "date", *num, "risk", "validation"), "personal", [F.col("date"), F.col("user_id")]))
    k = folds.first()["n_folds"]
    rows = []
    for i in range(1, k + 1):
        start = F.col("n_rows") - (k - i + 1) * F.col("test_size")
        train, test = folds.where(F.col("row_idx") < start), folds.where(F.col("test_fold") == i)
        if test.select("risk").distinct().count() < 2 or train.select("risk").distinct().count() < 2:
            continue
        fill = MD.Imputer(train, num)
        model = MD.make_pipeline(num, [], personal_gbt()).fit(fill(train))
        scored = cut_lineage(MD.score(model, fill(test), ["risk"]))
        auc = STS.roc_auc(scored, "p", "risk").first()["auc"]
        rep = STS.class_report(scored.select(F.col("risk").alias("y"), F.col("prediction").alias("pred")), "y", "pred", [0, 1]).where("cls = 1").first()
        rows.append((i, float(auc), float(rep["precision"]), float(rep["recall"])))
    per_fold = spark.createDataFrame(rows, "fold int, auc double, precision double, recall double")
    return AG.fold_summary(per_fold, ["auc", "precision", "recall"]).withColumn("n_folds", F.lit(len(rows)))


# ---------------------------------------------------------------- ST-03 source rules

POLLEN_SQL = """
WITH f AS (SELECT location_id, date,
    CASE WHEN day(date) % 4 = 0 THEN NULL ELSE pollen_tree END AS tree_index,
    CASE WHEN day(date) % 4 = 0 THEN NULL ELSE pollen_grass END AS grass_index,
    CASE WHEN day(date) % 4 = 0 THEN NULL ELSE pollen_weed END AS weed_index,
    CASE WHEN day(date) % 9 = 0 THEN 'timeout' END AS error,
    CASE WHEN latitude BETWEEN 24 AND 50 AND longitude BETWEEN -125 AND -66
         THEN CASE WHEN latitude < 37 THEN 'US_South' ELSE 'US' END END AS region FROM env_daily),
st AS (SELECT location_id, date, CAST(floor(AQI / 50) AS DOUBLE) AS tree_index,
              CASE WHEN day(date) % 3 = 0 THEN NULL ELSE CAST(floor(humidity / 25) AS DOUBLE) END AS grass_index,
              CAST(NULL AS DOUBLE) AS weed_index FROM env_daily WHERE day(date) % 2 = 0),
cal(month, tree_index, grass_index, weed_index) AS (VALUES
  (1, 4, 0, 0), (2, 4, 0, 0), (3, 4, 1, 0), (4, 4, 2, 0), (5, 3, 4, 0), (6, 2, 4, 1),
  (7, 2, 3, 2), (8, 2, 2, 3), (9, 2, 1, 4), (10, 1, 0, 4), (11, 1, 0, 2), (12, 3, 0, 0)),
j AS (SELECT f.*, s.tree_index AS s_t, s.grass_index AS s_g, s.weed_index AS s_w, s.location_id IS NOT NULL AS has_s,
             CAST(c.tree_index AS DOUBLE) AS c_t, CAST(c.grass_index AS DOUBLE) AS c_g, CAST(c.weed_index AS DOUBLE) AS c_w
      FROM f LEFT JOIN st s ON s.location_id = f.location_id AND s.date = f.date
      LEFT JOIN cal c ON f.region IS NOT NULL AND c.month = month(f.date)),
k AS (SELECT *, (tree_index IS NULL AND grass_index IS NULL AND weed_index IS NULL AND error IS NULL) AS empty,
             has_s AND (s_t IS NOT NULL OR s_g IS NOT NULL OR s_w IS NOT NULL) AS s_ok FROM j)
SELECT location_id, date,
  CASE WHEN empty AND region = 'US_South' AND s_ok THEN s_t WHEN empty AND region IS NOT NULL THEN c_t ELSE tree_index END AS tree_index,
  CASE WHEN empty AND region = 'US_South' AND s_ok THEN s_g WHEN empty AND region IS NOT NULL THEN c_g ELSE grass_index END AS grass_index,
  CASE WHEN empty AND region = 'US_South' AND s_ok THEN s_w WHEN empty AND region IS NOT NULL THEN c_w ELSE weed_index END AS weed_index,
  CASE WHEN empty AND region IS NOT NULL THEN NULL ELSE error END AS error,
  CASE WHEN empty AND region = 'US_South' AND s_ok THEN 'station' WHEN empty AND region IS NOT NULL THEN 'calendar' ELSE 'forecast' END AS source
FROM k"""


@query("st_03_pollen_source_priority", POLLEN_SQL, ["env_daily"])
def q_st03_pollen(spark, d):
    """ST-03 (pollen): forecast unless empty without error; then station (southern region,
    any index) or the regional calendar (JN-16, MA-16)."""
    e = T.env_daily(spark, d)
    day = F.dayofmonth("date")
    gap = day % 4 == 0
    forecast = e.select("location_id", "date", "latitude", "longitude",
                        F.when(gap, F.lit(None).cast("double")).otherwise(F.col("pollen_tree")).alias("tree_index"),
                        F.when(gap, F.lit(None).cast("double")).otherwise(F.col("pollen_grass")).alias("grass_index"),
                        F.when(gap, F.lit(None).cast("double")).otherwise(F.col("pollen_weed")).alias("weed_index"),
                        F.when(day % 9 == 0, F.lit("timeout")).alias("error"))
    station = e.where(day % 2 == 0).select(
        "location_id", "date", F.floor(F.col("AQI") / 50).cast("double").alias("tree_index"),
        F.when(day % 3 == 0, F.lit(None).cast("double")).otherwise(F.floor(F.col("humidity") / 25).cast("double"))
        .alias("grass_index"), F.lit(None).cast("double").alias("weed_index"))
    calendar = J.join_pollen_calendar(e.select("location_id", "date", "latitude", "longitude")) \
        .select("location_id", "date", "tree_index", "grass_index", "weed_index")
    return ST.pollen_priority(forecast, station, calendar, ["location_id", "date"],
                              M.pollen_region("latitude", "longitude"))


AIR_SQL = """
WITH a AS (SELECT location_id, date, PM2_5_mean AS pm25, AQI AS aqi, CASE WHEN day(date) % 5 = 0 THEN 'http 500' END AS error
           FROM env_daily),
b AS (SELECT location_id, date, PM2_5_max AS pm25, AQI / 2 AS aqi, CASE WHEN day(date) % 7 = 0 THEN 'no sensors' END AS error
      FROM env_daily WHERE location_id <> '9'),
j AS (SELECT coalesce(a.location_id, b.location_id) AS location_id, coalesce(a.date, b.date) AS date,
             a.location_id IS NULL OR a.error IS NOT NULL AS a_err, b.location_id IS NULL OR b.error IS NOT NULL AS b_err,
             coalesce(a.location_id, b.location_id) <> '8' AS coords,
             a.pm25 AS a_pm, a.aqi AS a_aqi, a.error AS a_e, b.pm25 AS b_pm, b.aqi AS b_aqi, b.error AS b_e
      FROM a FULL OUTER JOIN b ON a.location_id = b.location_id AND a.date = b.date),
m AS (SELECT *, 'default' AS mode, a_err AND coords AND NOT b_err AS pick_b FROM j
      UNION ALL SELECT *, 'prefer_secondary', coords AND NOT b_err FROM j)
SELECT location_id, date, mode, CASE WHEN pick_b THEN b_pm ELSE a_pm END AS pm25,
       CASE WHEN pick_b THEN b_aqi ELSE a_aqi END AS aqi, CASE WHEN pick_b THEN b_e ELSE a_e END AS error,
       CASE WHEN pick_b THEN 'secondary' ELSE 'primary' END AS source FROM m"""


@query("st_03_air_source_priority", AIR_SQL, ["env_daily"])
def q_st03_air(spark, d):
    """ST-03 (air quality): move on only on error; keep the first result when the fallback
    also errors; the preference can be reversed; no coordinates -> no fallback."""
    e = T.env_daily(spark, d)
    day = F.dayofmonth("date")
    a = e.select("location_id", "date", F.col("PM2_5_mean").alias("pm25"), F.col("AQI").alias("aqi"),
                 F.when(day % 5 == 0, F.lit("http 500")).alias("error"))
    b = e.where(F.col("location_id") != "9").select(
        "location_id", "date", F.col("PM2_5_max").alias("pm25"), (F.col("AQI") / 2).alias("aqi"),
        F.when(day % 7 == 0, F.lit("no sensors")).alias("error"))
    coords = F.col("location_id") != "8"
    out = []
    for mode, pref in (("default", False), ("prefer_secondary", True)):
        out.append(ST.air_priority(a, b, ["location_id", "date"], prefer_secondary=pref, has_coords=coords)
                   .withColumn("mode", F.lit(mode)))
    return out[0].unionByName(out[1])


ENV_PRIORITY_SQL = """
WITH win AS (SELECT * FROM env_daily WHERE date BETWEEN DATE '2024-01-28' AND DATE '2024-02-03'),
store AS (SELECT location_id, date, AQI, PM2_5_mean FROM win
          WHERE location_id NOT IN ('7', '8', '9') OR (location_id = '7' AND date = DATE '2024-01-30')),
locs AS (SELECT DISTINCT location_id FROM env_daily),
days AS (SELECT location_id, CAST(unnest(generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS date FROM locs),
j AS (SELECT location_id, date, ((date_diff('day', DATE '0001-01-01', date) + 1) % 7) / 7.0::DOUBLE AS j FROM days),
gen AS (SELECT location_id, date, CAST(40 + floor(30 * j) AS DOUBLE) AS AQI, 10.0 + 8 * j AS PM2_5_mean FROM j),
fc AS (SELECT location_id, date, 40.0 + 30 * j AS AQI, 10.0 + 8 * j AS PM2_5_mean FROM j WHERE location_id = '8'),
cnt AS (SELECT l.location_id, (SELECT count(*) FROM store s WHERE s.location_id = l.location_id) AS ns,
               (SELECT count(*) FROM fc f WHERE f.location_id = l.location_id) AS nf FROM locs l),
ch AS (SELECT location_id, CASE WHEN ns >= 2 THEN 'store' WHEN nf > 0 THEN 'forecast' ELSE 'generated' END AS source FROM cnt),
u AS (SELECT *, 'store' AS source FROM store UNION ALL SELECT *, 'forecast' FROM fc UNION ALL SELECT *, 'generated' FROM gen)
SELECT u.* FROM u JOIN ch ON ch.location_id = u.location_id AND ch.source = u.source"""


@query("st_03_env_source_priority", ENV_PRIORITY_SQL, ["env_daily"])
def q_st03_env(spark, d):
    """ST-03 (environment): stored rows when the store covers >= min(2, n+1) days of the
    window, else forecast rows, else generated rows (ST-04), decided per location."""
    e = T.env_daily(spark, d)
    s, t = F.lit("2024-01-28").cast("date"), F.lit("2024-02-03").cast("date")
    win = e.where(F.col("date").between(s, t))
    store = win.where(~F.col("location_id").isin("7", "8", "9")
                      | ((F.col("location_id") == "7") & (F.col("date") == F.lit("2024-01-30").cast("date")))) \
        .select("location_id", "date", "AQI", "PM2_5_mean")
    days = ST.expand_dates(e.select("location_id").distinct(), s, t).drop("day_idx")
    gen = ST.synthetic_env(days, "risk").select("location_id", "date", "AQI", "PM2_5_mean")
    fc = ST.synthetic_env(days.where(F.col("location_id") == "8"), "forecast").select("location_id", "date", "AQI",
                                                                                     "PM2_5_mean")
    return ST.env_source_priority(store, fc, gen, "location_id", n_days=6)


@query("fe_09_week_forecast_model")
def q_fe09_model(spark, d):
    """FE-09 with the model path: the general model (FE-01 + LB-01, ML-01/06) is trained on
    the stored history; the forecast window is completed with generated rows (JN-13, ST-04),
    FE-01 features are computed over history + window per location, the rows are scored
    (ML-13) and turned into {date, risk, activeRiskFactors, daily} records (MA-04, AJ-01, PRJ-14)."""
    from airwise.functions import labels as LBL
    from airwise.plans.training import GENERAL_CAT, GENERAL_NUM

    start, days = "2024-01-27", 7
    env = T.env_daily(spark, d).withColumn("AQI", F.col("AQI") / 2)  # the proxy on a daily scale, else every day is high risk
    hist = env.where(F.col("date") < start)
    train = LBL.high_risk_tomorrow(FE.env_features_general(hist)).withColumn("month", F.col("month").cast("double"))
    FLT.assert_trainable(train, "y")
    fill = MD.Imputer(train, GENERAL_NUM, GENERAL_CAT)  # fitted once, used for training and scoring
    train = cut_lineage(fill(train))
    model = MD.make_pipeline(GENERAL_NUM, GENERAL_CAT, MD.gbt("y")).fit(train)

    s = F.lit(start).cast("date")
    wanted = ST.expand_dates(env.select("location_id").distinct(), s, F.date_add(s, days - 1)).drop("day_idx")
    synth = ST.synthetic_env(wanted, "forecast")
    window = J.match_or_synthetic(wanted, env, synth.select(*[c for c in synth.columns]))
    cols = ["location_id", "date", "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind",
            "pressure", "rain", "pollen_tree", "pollen_grass", "pollen_weed", "day_of_week", "month", "season",
            "holiday_flag"]
    window = window.select(*[F.col(c) if c in window.columns else F.lit(None).alias(c) for c in cols])
    series = hist.select(*cols).unionByName(window.select(*[F.col(c).cast(t) for c, t in hist.select(*cols).dtypes]))
    feats = FE.env_features_general(series, drop_incomplete=False).where(F.col("date") >= start) \
        .withColumn("month", F.col("month").cast("double"))
    x = fill(feats)
    scored = MD.score(model, x, ["location_id", "date", "AQI", "PM2_5_mean", "pollen_total", "temp_min", "humidity"])
    rec = P.risk_record(F.date_format("date", "yyyy-MM-dd"), F.col("p"),
                        A.risk_factors("AQI", "PM2_5_mean", "pollen_total"),
                        F.struct("AQI", "PM2_5_mean", "pollen_total", "temp_min", "humidity"))
    out = scored.select("location_id", rec.alias("record"))
    return out.select("location_id", F.col("record.date").alias("date"), F.col("record.risk.score").alias("score"),
                      F.col("record.risk.level").alias("level"),
                      A.factor_ids(F.col("record.activeRiskFactors")).alias("factors"))
