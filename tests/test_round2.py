"""Rules that a wrong version would break: units, nulls in upserts, exact halves, per-series fallback, jobs per fit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airwise.functions import labels as L
from airwise.functions import mathx as M
from airwise.operators import filters as FL
from airwise.operators import projections as P
from airwise.operators import sinks as SK
from airwise.operators import windows as W
from airwise.plans import catalog
from airwise.plans import features as FE
from airwise.sources import tables as T
from tests.conftest import SMALL


def test_rain_unit_is_exact(spark):
    rows = [("in", 25.4), ("INCH", 25.4), ("wmoUnit:min", 1.0), ("mm", 1.0), (None, 1.0)]
    df = spark.createDataFrame([(u, 1.0, w) for u, w in rows], "u string, v double, want double")
    assert df.where(M.rain_to_mm("v", "u") != F.col("want")).count() == 0


def test_bounding_box_query_has_rows(spark):
    assert catalog.QUERIES["flt_08_bbox"](spark, SMALL).count() > 0


def test_set_upsert_writes_nulls_unless_told_otherwise(spark):
    old = spark.createDataFrame([(1, "94105", 5.0)], "k int, zip string, v double")
    new = spark.createDataFrame([(1, None, 6.0)], "k int, zip string, v double")
    table, count = SK.upsert_merge(old, new, ["k"])
    assert [tuple(r) for r in table.collect()] == [(1, None, 6.0)] and count.first()[0] == 1
    kept, _ = SK.upsert_merge(old, new, ["k"], null_keeps_old=True)
    assert [tuple(r) for r in kept.collect()] == [(1, "94105", 6.0)]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_one_class_labels_flip_exactly_half(spark, n):
    df = spark.sql(f"SELECT cast(id % 3 AS string) AS location_id, date_add(date '2024-01-01', cast(id AS int)) AS date, "
                   f"20.0D AS AQI, 5.0D AS PM2_5_mean FROM range({n})")
    assert L.demo_next_day(df).agg(F.sum("flare")).first()[0] == max(1, n // 2)


def test_fallback_is_per_series(spark):
    env = T.env_daily(spark, SMALL).where((F.col("location_id") != "1") | (F.dayofmonth("date") <= 5))
    got = {r["location_id"]: r["full_history"] for r in FE.flare_features_or_fallback(env).select("location_id", "full_history").distinct().collect()}
    assert got["1"] is False and set(got) == {r[0] for r in env.select("location_id").distinct().collect()}


def _jobs(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    action()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_jobs_of_median_fill_do_not_grow_with_columns(spark):
    cols = ["PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind", "pressure", "rain", "pollen_tree", "pollen_grass", "pollen_weed"]
    df = T.env_daily(spark, SMALL)
    few = _jobs(spark, "medians-2", lambda: P.fill_median(df, cols[:2]).write.format("noop").mode("overwrite").save())
    many = _jobs(spark, "medians-12", lambda: P.fill_median(df, cols).write.format("noop").mode("overwrite").save())
    assert many <= few + 2


def test_fills_take_the_first_value_backward(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, 5.0), ("a", 4, None), ("a", 5, 7.0), ("b", 1, None)], "k string, t int, v double")
    got = {(r.k, r.t): r.x for r in df.select("k", "t", W.ffill_bfill("v", W.series("k", "t")).alias("x")).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("a", 4): 5.0, ("a", 5): 7.0, ("b", 1): None}


def test_untrainable_data_is_refused(spark):
    one = spark.range(50).select(F.lit(1).alias("y"))
    with pytest.raises(ValueError, match="one class"):
        FL.assert_trainable(one, "y")
    with pytest.raises(ValueError, match="rows"):
        FL.assert_trainable(one.limit(3), "y")


def test_data_set_passes_read_stored_rows(spark, tmp_path):
    """FE-07: the passes of the quantiles read the stored data set; the landed tables are read and joined once, for all rows."""
    from __spark_entry__ import queries

    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int")).cast("timestamp")
    i = F.col("id")
    spark.range(240).select((i % 3).alias("l_suppkey"), day(i % 40).alias("l_shipdate"), (i % 50).cast("double").alias("l_quantity"), (i * 10.0).alias("l_extendedprice"),
                            (i % 8 / 100).alias("l_tax"), (i % 5 / 100).alias("l_discount"), (i % 7).cast("int").alias("l_linenumber"),
                            F.element_at(F.array(*map(F.lit, "RAN")), (i % 3 + 1).cast("int")).alias("l_returnflag"), F.when(i % 2 == 0, "O").otherwise("F").alias("l_linestatus")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).select(i.alias("o_orderkey"), day(i * i % 30).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    out = queries()["fe_07_dataset_build"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan and "o_orderdate" not in plan
    rows = out.collect()
    assert len({(r.locationid, r.date) for r in rows}) == len(rows) == spark.read.parquet(f"{tmp_path}/lineitem.parquet").select("l_suppkey", "l_shipdate").distinct().count()
    trend = sorted(r.google_trends_allergy for r in rows)
    at = 0.8 * (len(trend) - 1)
    edge = trend[int(at)] + (trend[min(int(at) + 1, len(trend) - 1)] - trend[int(at)]) * (at - int(at))
    assert all(r.flare_day == int(r.google_trends_allergy >= edge) for r in rows)


def test_daily_duplicates_come_from_one_rollup(spark):
    """Both measurements of a day come from one pass over the rollup, null ones included; a union held two rollups in a task."""
    from airwise.plans.catalog_sinks import _measured_twice

    b = spark.createDataFrame([("a", 1, 2.5), ("a", 1, 2.5), ("b", 1, None)], "location_id string, date int, PM2_5_mean double")
    dup = _measured_twice(b.groupBy("location_id", "date").agg(F.max("PM2_5_mean").alias("PM2_5_mean")))
    assert sorted(dup.collect(), key=repr) == sorted([("a", 1, 2.5), ("a", 1, 1.5), ("b", 1, None), ("b", 1, None)], key=repr)
    assert dup._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted(_measured_twice(b).collect(), key=repr) == sorted(b.unionByName(b.withColumn("PM2_5_mean", F.col("PM2_5_mean") - 1)).collect(), key=repr)


def test_model_scores_are_made_once_for_the_metrics(spark):
    """Accuracy and macro F1 read the predictions once; per-class values as by hand, nulls and classes without rows included."""
    from airwise.operators import stats as STS

    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (None, 1), (0, None), (7, 7)], "y int, pred int").repartition(3)
    rep = {r.cls: (r.precision, r.recall, r.f1, r.support) for r in STS.class_report(df, "y", "pred", [0, 1, 2, 3]).collect()}
    assert rep[0] == (0.5, 1 / 3, 0.4, 3) and rep[1] == (0.5, 1.0, 2 / 3, 2) and rep[2] == (0.0, 0.0, 0.0, 1) and rep[3] == (0.0, 0.0, 0.0, 0)
    out = STS.summary_metrics(df, "y", "pred", [0, 1, 2, 3])
    m = out.first()
    assert m.accuracy == 4 / 6 and abs(m.macro_f1 - (0.4 + 2 / 3) / 4) < 1e-12
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    none = STS.summary_metrics(df.where("y > 100"), "y", "pred", [0, 1]).first()
    assert none.accuracy is None and none.macro_f1 == 0.0


def test_general_model_reads_the_tables_once(spark, monkeypatch):
    """Only the split rows are made from the tables; what follows, the row counts included, reads them as stored."""
    from airwise.plans import training as TR

    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    stored, cut = [], TR.cut_lineage
    monkeypatch.setattr(TR, "cut_lineage", lambda df: (stored.append(reads(df)), cut(df))[1])
    out = TR.train_general(spark, "/root/testdata/sf0.001", max_iter=2)
    assert stored[0] > 0 and not any(stored[1:]) and reads(out) == 0
    assert out.first().n_train > 0
