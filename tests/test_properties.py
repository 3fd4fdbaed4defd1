"""Property checks: distributed primitives equal brute force, upserts are idempotent,
splits are disjoint and ordered, scores stay in range."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airwise.functions import mathx as M
from airwise.operators import models as MD
from airwise.operators import sinks as SK
from airwise.operators import stats as STS
from airwise.operators import windows as W
from tests.conftest import SMALL


def _brute_auc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    if not pos or not neg:
        return None
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.1, 0.2, 0.3, 0.5, 0.8]), st.integers(0, 1)), min_size=2, max_size=40))
def test_auc_equals_pair_count(spark, rows):
    df = spark.createDataFrame(rows, "p double, y int")
    got = STS.roc_auc(df, "p", "y").first().auc
    want = _brute_auc(rows)
    assert (got is None and want is None) or abs(got - want) < 1e-12


def test_row_index_is_a_permutation(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int")
    out = W.row_index(df, [F.col("g"), F.col("id")]).collect()
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    assert all(r.row_idx == want[r.id] for r in out) and all(r.n_rows == 300 for r in out)


def test_grouped_prefix_sums(spark):
    rows = [(g, i, float(i % 7)) for g in ("a", "b", "c") for i in range(100)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = W.prefix_sums(df, [F.col("i")], {"v": F.col("v")}, keys=["g"]).collect()
    for r in out:
        assert r.v_cum == sum(float(j % 7) for j in range(r.i + 1))
        assert r.v_total == sum(float(j % 7) for j in range(100))


def test_upsert_is_idempotent_and_unique(spark):
    from airwise.sources import tables as T
    b = T.daily_big(spark, SMALL).select("location_id", "date", "PM2_5_mean", "AQI")
    new = b.where(F.col("date") > "1998-01-01").withColumn("AQI", F.col("AQI") + 1)
    once, n1 = SK.upsert_merge(b, new, ["location_id", "date"])
    twice, n2 = SK.upsert_merge(once, new, ["location_id", "date"])
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert n2.first().n_upserted == 0 and n1.first().n_upserted > 0
    assert once.groupBy("location_id", "date").count().where("count > 1").count() == 0


def test_time_split_disjoint_and_ordered(spark):
    from airwise.sources import tables as T
    df = T.daily_big(spark, SMALL).select("location_id", "date")
    s = W.time_split(df, 0.8, [F.col("date"), F.col("location_id")])
    tr = s.where("split = 'train'").agg(F.max("row_idx")).first()[0]
    te = s.where("split = 'test'").agg(F.min("row_idx")).first()[0]
    assert tr + 1 == te
    last_train = s.where("split = 'train'").agg(F.max("date")).first()[0]
    first_test = s.where("split = 'test'").agg(F.min("date")).first()[0]
    assert last_train <= first_test


def test_stratified_split_sizes(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = MD.stratified_split(df, "y", "id", 0.8).groupBy("y", "split").count().collect()
    got = {(r.y, r.split): r["count"] for r in out}
    assert got == {(0, "train"): 120, (0, "test"): 30, (1, "train"): 40, (1, "test"): 10}


def test_scores_in_range(spark):
    df = spark.range(0, 1001).select((F.col("id") / 1000.0).alias("p"))
    s = df.select(M.proba_to_score("p").alias("a"), M.binary_score("p").alias("b"), M.display_score(F.col("p") * 6).alias("c"))
    agg = s.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.min("c"), F.max("c")).first()
    assert all(1.0 <= v <= 5.0 for v in agg)


def test_lags_never_look_ahead(spark):
    from airwise.plans import features as FE
    from airwise.sources import tables as T
    env = T.env_daily(spark, SMALL)
    fe = FE.env_features_general(env, drop_incomplete=False)
    j = fe.alias("f").join(env.alias("e"), (F.col("f.location_id") == F.col("e.location_id"))
                           & (F.col("e.date") == F.date_sub(F.col("f.date"), 1)))
    bad = j.where(F.col("f.pm25_mean_lag1").isNotNull()
                  & ~F.col("f.pm25_mean_lag1").eqNullSafe(F.col("e.PM2_5_mean")))
    assert bad.count() == 0
