"""Queries: statistics (ML-08..12), model preparation (ML-01..04, ML-15), severity and
model-matrix features (FE-05/06), dataset build (FE-07) and model training/scoring."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from airwise.functions import arrays as A
from airwise.functions import labels as L
from airwise.operators import ensembles as EN
from airwise.operators import joins as J
from airwise.operators import models as MD
from airwise.operators import projections as P
from airwise.operators import sorts as SL
from airwise.operators import stats as STS
from airwise.operators import windows as W
from airwise.plans import features as FE
from airwise.operators import quantiles as Q
from airwise.operators import sinks as SK
from airwise.plans.catalog_env import PROBA_SQL, fe01_sql, lb01_sql
from airwise.plans.registry import query
from airwise.plans.sqlviews import calendar_sql
from airwise.sources import tables as T

CLASSES10 = list(range(10))

# Ten class scores per vector: minus the squared distance to each class's centroid over all 64 entries.
SCORE_SQL = """
e AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label AS cls, i, avg(x) AS m FROM e GROUP BY label, i),
l AS (SELECT vec_id, e.label, CAST(cls AS INTEGER) AS cls, round(-sum((x - m) * (x - m)), 9) AS score
      FROM e JOIN cen ON e.i = cen.i GROUP BY vec_id, e.label, cls)"""


def class_scores(spark, d):
    """vec_id, label, scores: one score per class (0..9; null for a class without rows).  The centroids
    are a table with one row per class; it is inlined as a scalar array."""
    v = T.vectors(spark, d)
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centroids = one.agg(F.map_from_entries(F.collect_list(F.struct("label", F.transform("c", lambda y: y["m"]))))).scalar()
    rows = v.select("vec_id", "label", F.transform("embedding", lambda y: y.cast("double")).alias("x"), centroids.alias("cs"))

    def score(cls):
        far = F.zip_with("x", F.try_element_at("cs", F.lit(cls).cast(v.schema["label"].dataType)), lambda a, b: (a - b) * (a - b))
        return F.round(-F.aggregate(far, F.lit(0.0), lambda a, b: a + b), 9)

    return rows.select("vec_id", "label", F.array(*[score(c) for c in CLASSES10]).alias("scores"))


@query("ml_08_roc_auc", """
WITH c AS (SELECT p AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
           FROM scored GROUP BY p),
w AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS neg_below FROM c)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN CAST(sum(pos * neg_below + 0.5 * pos * neg) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc
FROM w""", ["scored"])
def q_ml08(spark, d):
    """ML-08: exact ROC-AUC with ties (rank form, distributed prefix sums)."""
    return STS.roc_auc(T.scored(spark, d), "p", "y")


@query("ml_09_ovr_auc", "WITH " + SCORE_SQL + """,
c AS (SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = cls THEN 0 ELSE 1 END) AS neg
      FROM l GROUP BY cls, score),
w AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS neg_below FROM c)
SELECT cls, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                 THEN CAST(sum(pos * neg_below + 0.5 * pos * neg) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc
FROM w GROUP BY cls""", [])
def q_ml09(spark, d):
    """ML-09: one-vs-rest AUC per class (centroid scores), per-class prefix sums."""
    return STS.ovr_auc(class_scores(spark, d), "scores", "label", CLASSES10).select(F.col("cls").cast("int").alias("cls"), "auc")


@query("ml_10_brier_and_rates", """
SELECT avg((p - y) * (p - y)) AS brier, avg(CAST(y AS DOUBLE)) AS positive_rate FROM scored""", ["scored"])
def q_ml10(spark, d):
    """ML-10 (Brier score) with AG-18 (positive rate)."""
    s = T.scored(spark, d)
    return STS.brier(s, "p", "y").select("brier", s.agg(F.avg(F.col("y").cast("double"))).scalar().alias("positive_rate"))


PRED_SQL = SCORE_SQL + """,
pr AS (SELECT vec_id, label AS y, CAST(arg_min(cls, (-score, cls)) AS INTEGER) AS pred FROM l GROUP BY vec_id, label)"""


def _vec_preds(spark, d):
    return class_scores(spark, d).select("vec_id", F.col("label").alias("y"), A.argmax(F.col("scores")).alias("pred"))


@query("ml_11_class_report", "WITH " + PRED_SQL + """,
spine AS (SELECT unnest(range(10)) AS cls),
tp AS (SELECT y AS cls, count(*) AS tp FROM pr WHERE y = pred GROUP BY y),
sup AS (SELECT y AS cls, count(*) AS support FROM pr GROUP BY y),
prd AS (SELECT pred AS cls, count(*) AS predicted FROM pr GROUP BY pred),
j AS (SELECT s.cls, coalesce(tp.tp, 0) AS tp, coalesce(sup.support, 0) AS support, coalesce(prd.predicted, 0) AS predicted
      FROM spine s LEFT JOIN tp ON tp.cls = s.cls LEFT JOIN sup ON sup.cls = s.cls LEFT JOIN prd ON prd.cls = s.cls),
m AS (SELECT cls, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, support FROM j)
SELECT CAST(cls AS INTEGER) AS cls, precision, recall,
       coalesce(2 * precision * recall / nullif(precision + recall, 0.0), 0.0) AS f1, support FROM m""", [])
def q_ml11(spark, d):
    """ML-11: per-class precision / recall / F1 / support (zero division -> 0) over a dense class list."""
    r = STS.class_report(_vec_preds(spark, d), "y", "pred", CLASSES10)
    return r.select(F.col("cls").cast("int").alias("cls"), "precision", "recall", "f1", "support")


@query("ml_11_accuracy_macro_f1", "WITH " + PRED_SQL + """,
spine AS (SELECT unnest(range(10)) AS cls),
j AS (SELECT s.cls, (SELECT count(*) FROM pr WHERE y = pred AND y = s.cls) AS tp,
             (SELECT count(*) FROM pr WHERE y = s.cls) AS support, (SELECT count(*) FROM pr WHERE pred = s.cls) AS predicted
      FROM spine s),
m AS (SELECT coalesce(tp / nullif(predicted, 0), 0.0) AS pr_, coalesce(tp / nullif(support, 0), 0.0) AS rc FROM j)
SELECT (SELECT avg(CAST(y = pred AS DOUBLE)) FROM pr) AS accuracy,
       avg(coalesce(2 * pr_ * rc / nullif(pr_ + rc, 0.0), 0.0)) AS macro_f1 FROM m""", [])
def q_ml11b(spark, d):
    """ML-11: accuracy and macro F1."""
    return STS.summary_metrics(_vec_preds(spark, d), "y", "pred", CLASSES10)


@query("ml_12_confusion_matrix", "WITH " + PRED_SQL + """,
spine AS (SELECT a.t AS true_class, b.p AS pred_class FROM (SELECT unnest(range(10)) AS t) a, (SELECT unnest(range(10)) AS p) b),
c AS (SELECT y AS true_class, pred AS pred_class, count(*) AS n FROM pr GROUP BY y, pred)
SELECT CAST(s.true_class AS INTEGER) AS true_class, CAST(s.pred_class AS INTEGER) AS pred_class, coalesce(c.n, 0) AS n
FROM spine s LEFT JOIN c ON c.true_class = s.true_class AND c.pred_class = s.pred_class""", [])
def q_ml12(spark, d):
    """ML-12: dense confusion matrix over the class list (zeros kept)."""
    return STS.confusion_matrix(_vec_preds(spark, d), "y", "pred", CLASSES10)


@query("ml_12_roc_curve", """
WITH c AS (SELECT p AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
           FROM scored GROUP BY p),
w AS (SELECT score, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM c
      WINDOW o AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT score AS threshold, fp / nullif(N, 0) AS fpr, tp / nullif(P, 0) AS tpr FROM w""", ["scored"])
def q_ml12b(spark, d):
    """ML-12: ROC curve points at every distinct score (descending thresholds)."""
    return STS.roc_curve(T.scored(spark, d), "p", "y")


@query("ml_01_02_04_prep", """
WITH s AS (SELECT doc_id, y, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE p END AS p,
                  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM scored),
st AS (SELECT quantile_cont(p, 0.5) AS med FROM s),
md AS (SELECT lang AS mode_lang FROM s WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
f AS (SELECT doc_id, y, coalesce(p, (SELECT med FROM st)) AS p, coalesce(lang, (SELECT mode_lang FROM md)) AS lang FROM s),
z AS (SELECT avg(p) AS mu, stddev_pop(p) AS sd FROM f),
w AS (SELECT y, count(*) AS c FROM f GROUP BY y)
SELECT f.doc_id, f.y, f.lang, (f.p - z.mu) / CASE WHEN z.sd = 0 THEN 1.0 ELSE z.sd END AS p_z,
       CAST((SELECT count(*) FROM f) AS DOUBLE) / ((SELECT count(DISTINCT y) FROM f) * w.c) AS weight
FROM f, z, w WHERE w.y = f.y""", ["scored"])
def q_ml01(spark, d):
    """ML-01 (median / mode imputation), ML-02 (population-std scaling), ML-04 (balanced weights)."""
    s = T.scored(spark, d).select("doc_id", "y",
                                  F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("p")).alias("p"),
                                  F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("lang"))
    f = MD.impute(s, s, ["p"], ["lang"])
    z = MD.standardize(f, f, ["p"]).withColumnRenamed("p", "p_z")
    return MD.balanced_weights(z, "y").select("doc_id", "y", "lang", "p_z", "weight")


@query("ml_15_stratified_split_counts", """
WITH c AS (SELECT y, count(*) AS n FROM scored GROUP BY y)
SELECT y, 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM c
UNION ALL SELECT y, 'test', CAST(n - floor(n * 0.8) AS BIGINT) FROM c""", ["scored"])
def q_ml15(spark, d):
    """ML-15: exact stratified 80/20 split (seeded hash rank within class); per (class, split) sizes."""
    s = MD.stratified_split(T.scored(spark, d), "y", "doc_id", 0.8, seed=42)
    return s.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n"))


@query("ml_15_stratified_split_rows", """
WITH r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS i,
                  count(*) OVER (PARTITION BY y) AS n FROM scored)
SELECT doc_id, y, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""", ["scored"])
def q_ml15b(spark, d):
    """ML-15: the split rows themselves (order: MD5 of seed and key, then key)."""
    return MD.stratified_split(T.scored(spark, d), "y", "doc_id", 0.8, seed=42).select("doc_id", "y", "split")


@query("fe_05_severity_features", """
WITH last AS (SELECT date, arg_max_null(AQI, latitude) AS aqi, arg_max_null(PM2_5_mean, latitude) AS pm25_mean,
                     arg_max_null(PM2_5_max, latitude) AS pm25_max, arg_max_null(pollen_tree, latitude) AS tree,
                     arg_max_null(pollen_grass, latitude) AS grass, arg_max_null(pollen_weed, latitude) AS weed,
                     arg_max_null(humidity, latitude) AS humidity_mean, arg_max_null(humidity + 5, latitude) AS humidity_max,
                     arg_max_null(wind, latitude) AS wind, arg_max_null(rain, latitude) AS rain, arg_max_null(temp_max, latitude) AS temp_max
              FROM env_daily GROUP BY date)
SELECT c.user_id, c.date,
  coalesce(l.aqi, 0) AS aqi, coalesce(coalesce(nullif(l.pm25_mean, 0), l.pm25_max), 0) AS pm25,
  coalesce(l.tree, 0) AS tree_index, coalesce(l.grass, 0) AS grass_index, coalesce(l.weed, 0) AS weed_index,
  coalesce(l.tree, 0) + coalesce(l.grass, 0) + coalesce(l.weed, 0) AS weighted_pollen,
  coalesce(coalesce(nullif(l.humidity_mean, 0), l.humidity_max), 0) AS humidity,
  coalesce(l.wind, 0) AS wind_speed_kmh, coalesce(l.rain, 0) AS rain_mm, coalesce(l.temp_max, 0) AS temp_max_c,
  coalesce(c.symptomScore, 0) AS symptom_score_today, CAST(coalesce(c.symptomScore >= 4, false) AS INTEGER) AS y
FROM checkins c JOIN last l ON c.date = l.date""", ["checkins", "env_daily"])
def q_fe05(spark, d):
    """FE-05: 11-column severity vector from the last env row per date (JN-04); 0/null falls
    through to the alternative (Q14); label severe (LB-03)."""
    from airwise.plans.severity import severity_features
    return severity_features(spark, d)


MATRIX_NUM = ["latitude", "longitude", "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind", "pressure", "rain",
              "pollen_tree", "pollen_grass", "pollen_weed", "month"]
_MEDIANS = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in MATRIX_NUM)
_FILLED = ", ".join(f"CAST(coalesce(e.{c}, st.m_{c}, 0) AS DOUBLE) AS {c}" for c in MATRIX_NUM)


@query("fe_06_wn_15_model_matrix", f"""
WITH tr AS (SELECT * FROM env_daily WHERE date < DATE '2024-01-22'),
st AS (SELECT {_MEDIANS} FROM tr),
zp AS (SELECT zip_code, CAST(dense_rank() OVER (ORDER BY zip_code) - 1 AS INTEGER) AS zip_code_code FROM (SELECT DISTINCT zip_code FROM tr WHERE zip_code IS NOT NULL)),
dw AS (SELECT day_of_week, CAST(dense_rank() OVER (ORDER BY day_of_week) - 1 AS INTEGER) AS day_of_week_code
       FROM (SELECT DISTINCT day_of_week FROM tr)),
se AS (SELECT season, CAST(dense_rank() OVER (ORDER BY season) - 1 AS INTEGER) AS season_code FROM (SELECT DISTINCT season FROM tr))
SELECT e.location_id, e.date, {_FILLED}, coalesce(zp.zip_code_code, 0) AS zip_code_code,
       coalesce(dw.day_of_week_code, 0) AS day_of_week_code, coalesce(se.season_code, 0) AS season_code,
       CAST(CAST(e.holiday_flag AS INTEGER) AS DOUBLE) AS holiday_flag
FROM env_daily e CROSS JOIN st LEFT JOIN zp ON zp.zip_code = e.zip_code LEFT JOIN dw ON dw.day_of_week = e.day_of_week LEFT JOIN se ON se.season = e.season""",
       ["env_daily"])
def q_fe06(spark, d):
    """FE-06 (+PRJ-16, WN-15): model matrix fitted on the training window: median fill,
    sorted category codes (unseen -> 0), bool -> number."""
    e = T.env_daily(spark, d)
    train = e.where(F.col("date") < "2024-01-22")
    x = MD.impute(train, e, MATRIX_NUM)
    for c in ("zip_code", "day_of_week", "season"):
        x = MD.label_codes(train, x, c)
    return x.select("location_id", "date", *MATRIX_NUM, "zip_code_code", "day_of_week_code", "season_code",
                    F.col("holiday_flag").cast("int").cast("double").alias("holiday_flag"))


AIR_COLS = ["PM2_5_mean", "PM2_5_max", "AQI"]
WEATHER_COLS = ["temp_min", "temp_max", "humidity", "wind", "pressure", "rain"]
_MEASURES = AIR_COLS + WEATHER_COLS


def _gapped_sql(cols, every):
    return ", ".join(f"CASE WHEN (CAST(location_id AS INTEGER) + day(date)) % {every} <> 0 THEN {c} END AS {c}" for c in cols)


FE07_BASE = f"""
w AS (SELECT location_id, date, {_gapped_sql(WEATHER_COLS, 7)} FROM daily_big),
a AS (SELECT location_id, date, {_gapped_sql(AIR_COLS, 11)} FROM daily_big),
wa AS (SELECT coalesce(w.location_id, a.location_id) AS location_id, coalesce(w.date, a.date) AS date, {', '.join(_MEASURES)}
       FROM w FULL OUTER JOIN a ON w.location_id = a.location_id AND w.date = a.date),
p AS (SELECT location_id, date, latitude, longitude, zip_code, pollen_tree, pollen_grass, pollen_weed FROM daily_big),
ds AS (SELECT e.*, p.latitude, p.longitude, p.zip_code, p.pollen_tree, p.pollen_grass, p.pollen_weed, t.n_orders
       FROM wa e LEFT JOIN p ON p.location_id = e.location_id AND p.date = e.date LEFT JOIN trends t ON e.date = t.date)"""


def _gapped_measures(b):
    """JN-01 over whole tables: weather and air of every location and day, whose measures are null on some days."""
    k = F.col("location_id").cast("int") + F.dayofmonth("date")
    gap = lambda cols, every: [F.when(k % every != 0, F.col(c)).alias(c) for c in cols]
    return J.join_weather_air(b.select("location_id", "date", *gap(WEATHER_COLS, 7)), b.select("location_id", "date", *gap(AIR_COLS, 11)))


@query("fe_07_dataset_build", "WITH " + FE07_BASE + f""",
f AS (SELECT *, coalesce(last_value(n_orders IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(n_orders IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS tv
      FROM ds),
q AS (SELECT quantile_cont(tv, 0.8) AS thr, quantile_cont(tv, [0.2, 0.4, 0.6, 0.8]) AS edges FROM f)
SELECT location_id AS locationid, latitude, longitude, zip_code, date, {', '.join(_MEASURES)}, pollen_tree, pollen_grass, pollen_weed,
       {calendar_sql()}, CAST(tv AS DOUBLE) AS google_trends_allergy,
       CAST(tv >= thr AS INTEGER) AS flare_day,
       CAST(1 + (tv > edges[1])::INTEGER + (tv > edges[2])::INTEGER + (tv > edges[3])::INTEGER + (tv > edges[4])::INTEGER AS INTEGER) AS risk
FROM f, q""", ["daily_big", "trends"])
def q_fe07(spark, d):
    """FE-07: daily weather and air (each over the whole table, measures missing on some days) joined full outer (JN-01), place and pollen, trends
    (JN-02), ffill/bfill (WN-11), calendar columns, flare by p80 (LB-06), risk quintiles (LB-07), trends
    renamed (PRJ-12), known columns first (PRJ-09): the 24-column data set."""
    b = T.daily_big(spark, d)
    e = _gapped_measures(b)
    place = b.select("location_id", "date", "latitude", "longitude", "zip_code", "pollen_tree", "pollen_grass", "pollen_weed")
    ds = J.join_trends(e.join(place, ["location_id", "date"], "left"), T.trends(spark, d))
    ds = ds.withColumn("trend", W.ffill_bfill("n_orders", W.series("location_id")).cast("double")).drop("n_orders")
    # stored once: the passes of the quantiles read one column of it, not the tables, joins and windows again
    ds = SK.stored(ds.select("*", *T._calendar_cols()), "data-set")
    ds = L.flare_and_bins(ds, "trend")
    ds = P.rename_trend(ds, "allergy").withColumnRenamed("location_id", "locationid")
    return P.order_columns(ds, ["locationid", "latitude", "longitude", "zip_code", "date", *_MEASURES])


def _general_training_frame(spark, d):
    fe = FE.env_features_general(T.daily_big(spark, d))
    return L.high_risk_tomorrow(fe)


@query("ml_03_05_06_13_16_general_model")
def q_ml_general(spark, d):
    """ML-03/06/13/16 + WN-13 + ML-08/10 + SL-03: train the general GBT on FE-01 features with a
    chronological split, save/load the bundle, score the test rows and report AUC, Brier, P@20%."""
    from airwise.plans.training import train_general
    return train_general(spark, d)


#: A stored ensemble (a parameter of the query below): a leaf is a margin; an inner node is (feature, threshold, left, right), left where the
#: feature is at most the threshold; a one-hot feature is "column=category".
STORED_TREES = [
    ("AQI", 62.5, ("PM2_5_mean", 14.25, -0.9, ("season=summer", 0.5, -0.35, 0.2)), ("humidity", 71.0, 0.4, ("wind", 6.5, 0.85, 0.55))),
    ("pollen_tree", 2.5, ("temp_max", 24.0, -0.4, ("AQI", 48.0, -0.1, 0.3)), ("season=spring", 0.5, 0.15, 0.6)),
    ("rain", 0.75, ("pollen_weed", 1.5, ("PM2_5_max", 22.5, -0.25, 0.2), 0.35), ("season=winter", 0.5, -0.3, -0.5)),
]
STORED_WEIGHTS = [1.0, 0.6, 0.4]
SEASONS = ["fall", "spring", "summer", "winter"]
_CUTS = [0.25, 0.5]


def stored_bundle(features: list) -> EN.Bundle:
    """The stored ensemble over ``features`` (column names, or (column, category) of one-hot ones)."""
    place = {f if isinstance(f, str) else f"{f[0]}={f[1]}": i for i, f in enumerate(features)}
    nodes: list[tuple] = []

    def add(tree: int, spec, ids) -> int:
        at = next(ids)
        if not isinstance(spec, tuple):
            nodes.append((tree, at, None, None, None, None, None, [float(spec)], STORED_WEIGHTS[tree]))
            return at
        feature, cut, left, right = spec
        nodes.append((tree, at, place[feature], float(cut), None, add(tree, left, ids), add(tree, right, ids), None, STORED_WEIGHTS[tree]))
        return at

    for t, spec in enumerate(STORED_TREES):
        add(t, spec, itertools.count())
    return EN.Bundle("boosted", features, {"season": SEASONS}, nodes, {"target": "y", "target_type": "binary"})


def _tree_sql(spec) -> str:
    if not isinstance(spec, tuple):
        return repr(float(spec))
    feature, cut, left, right = spec
    column, _, category = feature.partition("=")
    x = f"(season = '{category}')::INTEGER" if category else column
    return f"(CASE WHEN {x} <= {cut} THEN {_tree_sql(left)} ELSE {_tree_sql(right)} END)"


def _stored_sql() -> str:
    margin = " + ".join(f"CAST({w} AS DOUBLE) * {_tree_sql(t)}" for w, t in zip(STORED_WEIGHTS, STORED_TREES))
    return f"""
m AS (SELECT location_id, date, {margin} AS margin FROM daily_big),
p AS (SELECT location_id, date, 1.0 / (1.0 + exp(-2.0 * margin)) AS p FROM m)
SELECT location_id, date, 1.0 - p AS p0, p AS p1, CAST(p > 1.0 - p AS INTEGER) AS prediction,
       floor((1 + 4 * p) * 10 + 0.5) / 10 AS shown, CASE WHEN p < 0.25 THEN 'low' WHEN p < 0.5 THEN 'moderate' ELSE 'high' END AS level,
       'y' AS target FROM p"""


@query("ml_13_16_stored_ensemble", "WITH " + _stored_sql(), ["daily_big"])
def q_stored_ensemble(spark, d):
    """ML-13 + ML-16 + ML-03 + PRJ-15 + MA-19: a saved bundle of trees is loaded and compiled to columns; features by
    exclusion of ids, date and target, seasons one-hot; probabilities, prediction and the score rounded half up to one place for every
    supplier-day."""
    df = T.daily_big(spark, d)
    num, _ = P.feature_columns(df, target="y")
    bundle = EN.load(EN.save(stored_bundle([*num, *[("season", s) for s in SEASONS]]), SK.scratch_path(spark, "stored-ensemble")))
    out = EN.score(bundle, df, ["location_id", "date"])
    p = F.col("p")
    return out.select("location_id", "date", F.col("probs")[0].alias("p0"), p.alias("p1"), "prediction",
                      (F.floor((1 + 4 * p) * 10 + 0.5) / 10).alias("shown"),
                      F.when(p < _CUTS[0], "low").when(p < _CUTS[1], "moderate").otherwise("high").alias("level"), F.lit(bundle.meta["target"]).alias("target"))


@query("ml_05_07_14_sl_07_model_search")
def q_ml_search(spark, d):
    """ML-04/05/07/14 + SL-07: balanced RF random search over expanding folds, then an LR
    refit; top-10 feature weights."""
    from airwise.plans.training import search_and_weights
    return search_and_weights(spark, d)


@query("sl_03_precision_at_k_outlook", "WITH " + fe01_sql("daily_big") + "," + lb01_sql() + f""",
r AS (SELECT y, row_number() OVER (ORDER BY {PROBA_SQL} DESC, location_id || '|' || CAST(date AS VARCHAR)) - 1 AS i,
             count(*) OVER () AS n FROM lb)
SELECT avg(CAST(y AS DOUBLE)) AS precision_at_k, count(*) AS k, max(n) AS n
FROM r WHERE i < greatest(1, ceil(n * 0.2))""", ["daily_big"])
def q_sl03b(spark, d):
    """SL-03 on the outlook: precision of the top 20% location-days by rule probability."""
    from airwise.plans.catalog_env import outlook
    o = outlook(T.daily_big(spark, d)).withColumn("key", F.concat_ws("|", "location_id", F.col("date").cast("string")))
    return SL.precision_at_k(o, "proba", "y", 0.2, tie="key")


OVR_LONG_SQL = SCORE_SQL + """,
c AS (SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = cls THEN 0 ELSE 1 END) AS neg
      FROM l GROUP BY cls, score)"""


@query("ml_09_macro_auc", "WITH " + OVR_LONG_SQL + """,
w AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS neg_below FROM c),
a AS (SELECT cls, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                       THEN CAST(sum(pos * neg_below + 0.5 * pos * neg) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END AS auc
      FROM w GROUP BY cls)
SELECT avg(auc) AS macro_auc FROM a""", [])
def q_ml09b(spark, d):
    """ML-09: macro mean of the one-vs-rest AUCs (classes with an undefined AUC skipped)."""
    return STS.macro_auc(STS.ovr_auc(class_scores(spark, d), "scores", "label", CLASSES10))


@query("ml_12_ovr_roc_curves", "WITH " + OVR_LONG_SQL + """
SELECT cls, score AS threshold,
       sum(neg) OVER o / nullif(sum(neg) OVER (PARTITION BY cls), 0) AS fpr,
       sum(pos) OVER o / nullif(sum(pos) OVER (PARTITION BY cls), 0) AS tpr
FROM c WINDOW o AS (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", [])
def q_ml12c(spark, d):
    """ML-12: one-vs-rest ROC curves per class (per-class distributed prefix sums)."""
    return STS.ovr_roc_curves(class_scores(spark, d), "scores", "label", CLASSES10).select(F.col("cls").cast("int").alias("cls"),
                                                                      "threshold", "fpr", "tpr")


@query("ml_02_05_07_11_15_stratified_models")
def q_ml_strat(spark, d):
    """ML-15 stratified split, ML-02 scaling fitted on train, ML-04 weights, ML-05 random forest
    with the reference settings and ML-07 logistic regression, scored with ML-11 on the test rows."""
    from airwise.plans.training import stratified_models
    return stratified_models(spark, d)
