"""Hand-made frames for the reference's edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from airwise.functions import arrays as A
from airwise.functions import dates as D
from airwise.functions import labels as L
from airwise.functions import mathx as M
from airwise.functions import strings as S
from airwise.operators import models as MD
from airwise.operators import stats as STS
from airwise.operators import windows as W
from airwise.plans import features as FE


def test_score_edges_not_monotonic(spark):
    df = spark.createDataFrame([(0.1999,), (0.2,), (0.4999,), (0.5,)], "p double")
    got = [(r.s, r.l) for r in df.select(M.proba_to_score("p").alias("s"), M.proba_to_level("p").alias("l")).collect()]
    assert got == [(2.0, "low"), (2.0, "moderate"), (5.0, "moderate"), (4.0, "high")]


def test_aqi_pm_segments(spark):
    df = spark.createDataFrame([(12.0,), (12.1,), (50.0,), (500.0,), (501.0,)], "a double")
    pm = [r[0] for r in df.select(M.aqi_to_pm25("a")).collect()]
    assert pm[0] == 12.0 and abs(pm[1] - (12.1 + 12.1 * (35.4 - 12.1) / 50)) < 1e-12
    assert abs(pm[2] - 35.4) < 1e-9 and abs(pm[3] - 500.4) < 1e-9 and pm[4] == 500.4
    df2 = spark.createDataFrame([(12.0,), (35.4,), (500.4,), (600.0,), (-3.0,)], "p double")
    aqi = [r[0] for r in df2.select(M.pm25_to_aqi("p")).collect()]
    assert aqi == [50, 100, 500, 500, 0]


def test_computed_holidays(spark):
    days = [dt.date(2026, 1, 19), dt.date(2026, 11, 26), dt.date(2026, 5, 25), dt.date(2026, 7, 4),
            dt.date(2026, 9, 7), dt.date(2026, 10, 12), dt.date(2026, 2, 16), dt.date(2026, 11, 27)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(D.is_us_holiday("d")).collect()]
    assert got == [True, True, False, True, True, True, True, False]  # Memorial Day absent (Q23)


def test_rolling_full_needs_complete_window(spark):
    rows = [("a", dt.date(2024, 1, i), v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0], start=1)]
    df = spark.createDataFrame(rows, "location_id string, date date, x double")
    w = W.series("location_id")
    got = [r.r for r in df.select("date", W.rolling_full("x", w, 3).alias("r")).orderBy("date").collect()]
    assert got == [None, None, None, None, None, 5.0, 6.0]


def test_rolling_prev_partial_and_zero_start(spark):
    rows = [("u", dt.date(2024, 1, i), float(i)) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "user_id string, date date, x double")
    w = W.series("user_id")
    got = [r.r for r in df.select("date", W.rolling_prev("x", w, 3).alias("r")).orderBy("date").collect()]
    assert got == [0.0, 1.0, 1.5, 2.0]


def test_auc_one_class_is_null_and_ties_half(spark):
    one = spark.createDataFrame([(0.1, 1), (0.9, 1)], "p double, y int")
    assert STS.roc_auc(one, "p", "y").first().auc is None
    tie = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, y int")
    assert STS.roc_auc(tie, "p", "y").first().auc == 0.875


def test_unseen_category_code_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    df = spark.createDataFrame([("c",), ("zzz",), ("a",)], "c string")
    got = {r.c: r.c_code for r in MD.label_codes(train, df, "c").collect()}
    assert got == {"a": 0, "c": 2, "zzz": 0}


def test_zero_variance_scaling_divides_by_one(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.x for r in MD.standardize(df, df, ["x"]).collect()] == [0.0, 0.0]


def test_body_text_parsers(spark):
    rows = [("5'8\"", "68 kg"), ("5' 8\"", "150 lbs"), ("173 cm", "150"), ("1.73 m", "-3"), ("6'", "abc"), ("", "")]
    df = spark.createDataFrame(rows, "h string, w string")
    got = df.select(S.height_m("h").alias("m"), S.weight_kg("w").alias("kg"), S.height_in("h").alias("inch")).collect()
    assert abs(got[0].m - (5 * 0.3048 + 8 * 0.0254)) < 1e-12 and got[0].kg == 68.0 and got[0].inch == 68.0
    assert abs(got[1].kg - 150 / 2.205) < 1e-12 and got[1].inch == 68.0
    assert got[2].m == 1.73 and abs(got[2].kg - 150 / 2.205) < 1e-12 and got[2].inch is None
    assert got[3].m == 1.73 and got[3].kg is None
    assert abs(got[4].m - 6 * 0.3048) < 1e-12 and got[4].kg is None and got[4].inch == 72.0
    assert got[5].m is None and got[5].kg is None


def test_free_text_location(spark):
    rows = [("37.77490,-122.41940",), ("94107-1234",), ("  ",), ("Austin",), ("37,-122",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.text_to_location_id("t")).collect()]
    assert got == ["37.7749_-122.4194", "zip_94107", None, "Austin", "37_-122"]


def test_recommendation_parser(spark):
    fenced = '```json\n[{"id": "Stay In", "title": "Stay in", "description": "AQI high"}, {"title": "", "description": "x"}]\n```'
    wrapped = '{"items": [{"id": "a", "title": "T", "description": "D"}]}'
    prose = 'Sure! [{"title": "T2", "description": "D2"}]'
    trailing = 'Sure! [{"title": "T3", "description": "D3"}] hope it helps'
    df = spark.createDataFrame([(fenced,), (wrapped,), (prose,), ("not json",), (trailing,)], "t string")
    got = [[x.id for x in r[0]] for r in df.select(A.parse_recommendations("t")).collect()]
    default = [x[0] for x in A.DEFAULT_RECOMMENDATIONS]
    # the wrapped object contains '[' so parsing starts there and fails (as coded): default list
    assert got == [["stay-in"], default, ["rec-0"], default, default]


def test_synthetic_ordinal(spark):
    df = spark.createDataFrame([(dt.date(2026, 2, 7),)], "d date")
    assert df.select(D.iso_ordinal("d")).first()[0] == dt.date(2026, 2, 7).toordinal()


def test_fixed_week_factors(spark):
    """FIXTURES A2: 7 constant days; no air/PM/pollen factor, cold and humidity fire."""
    rows = [(dt.date(2026, 2, 7 + i), 53.0, 13.78, 0.0, -11.91, 84.12) for i in range(7)]
    df = spark.createDataFrame(rows, "date date, AQI double, PM2_5_mean double, pollen_total double, temp_min double, humidity double")
    got = {r[0] for r in df.select(A.factor_ids(A.risk_factors("AQI", "PM2_5_mean", "pollen_total", "temp_min", "humidity"))).collect()}
    assert got == {"temp,humidity"}
    three = {r[0] for r in df.select(A.factor_ids(A.risk_factors("AQI", "PM2_5_mean", "pollen_total"))).collect()}
    assert three == {"general"}


def test_quantile_bins_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    got = [r.risk for r in L.quantile_bins(df, "x", "risk").orderBy("x").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_fallback_features_when_history_too_short(spark):
    rows = [("a", dt.date(2024, 1, i), 10.0, 12.0, 50.0, 1.0, 5.0, 40.0, 2.0, 101000.0, 0.0, None, 1.0, 1.0)
            for i in range(1, 4)]
    cols = ("location_id string, date date, PM2_5_mean double, PM2_5_max double, AQI double, temp_min double, "
            "temp_max double, humidity double, wind double, pressure double, rain double, pollen_tree double, "
            "pollen_grass double, pollen_weed double")
    df = spark.createDataFrame(rows, cols)
    out = FE.flare_features_or_fallback(df)
    assert out.count() == 3 and "temp_range" in out.columns


def test_incomplete_rows_are_dropped_by_single_conditions(spark):
    """Null and NaN drop a row, as ``na.drop``; a frame fitted over many renamed columns still plans."""
    names = [f"c{i}" for i in range(24)]
    rows = [[float(i)] * 24 for i in range(6)]
    rows[1][3], rows[2][23], rows[3][0] = None, float("nan"), float("inf")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    kept = FE.drop_incomplete_rows(df, names)
    assert "atleastnnonnulls" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r.c1 for r in kept.collect()) == sorted(r.c1 for r in df.na.drop("any", subset=names).collect()) == [0.0, 3.0, 4.0, 5.0]
    assert sorted(r.c1 for r in MD.impute(kept, kept, names).collect()) == [0.0, 3.0, 4.0, 5.0]


def test_flare_means_come_from_lags(spark):
    """No frame of seven rows is summed for each row; the means are those of a frame, null where a value is missing."""
    rows = [("a", dt.date(2024, 1, 1 + i), None if i == 9 else float(i * i)) for i in range(18)]
    others = [F.lit(1.0).alias(c) for c in FE.FLARE_BASE_COLS if c not in ("PM2_5_mean", "temp_range", "pm_spike", "humid_x_pm", "wind_x_pm")]
    df = spark.createDataFrame(rows, "location_id string, date date, PM2_5_mean double").select("*", *others)
    out, _ = FE._flare_rows(df, "location_id")
    assert "RowFrame, -6, currentrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    values = [r[2] for r in rows]
    want = [None if i < 6 or None in values[i - 6:i + 1] else sum(values[i - 6:i + 1]) / 7 for i in range(18)]
    assert [r.PM2_5_mean_roll7 for r in out.orderBy("date").collect()] == want


def test_standardize_names_its_statistics_once(spark):
    df = spark.range(4).select("id", *[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(3)], F.lit(5.0).alias("k"))
    out = MD.standardize(df, df, ["c0", "c1", "c2", "k"])
    assert out._jdf.queryExecution().analyzed().toString().count("scalar-subquery") <= 1
    assert [round(r.c2, 6) for r in out.orderBy("id").collect()] == [-1.341641, -0.447214, 0.447214, 1.341641]
    assert {r.k for r in out.collect()} == {0.0}
