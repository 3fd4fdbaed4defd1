"""The reference's six-step smoke flow, on the smallest data set: stores reachable, user and
nested check-in totals, env count and date range, model bundle round trip, features + predict,
and the forecast records carry user_id, date and a risk score."""

from pyspark.sql import functions as F

from airwise.operators import aggregates as AG
from airwise.operators import models as MD
from airwise.operators import sinks as SK
from airwise.plans import features as FE
from airwise.sources import tables as T
from tests.conftest import SMALL


def test_six_step_smoke(spark):
    users = T.users(spark, SMALL)
    nested = SK.nest_checkins(users.select("user_id"), T.checkins(spark, SMALL))
    assert users.count() > 0                                                   # step 2: users
    assert AG.total_checkins(nested).first()[0] == T.checkins(spark, SMALL).count()
    env = T.env_daily(spark, SMALL)
    lo, hi = AG.date_range(env).first()                                        # step 3: env + dates
    assert env.count() > 0 and lo <= hi
    train = FE.symptom_lags(T.checkins(spark, SMALL)).withColumn("risk", (F.col("symptom_score") >= 4).cast("int"))
    feats = ["wheeze_lag1", "cough_lag1", "chestTightness_lag1", "symptom_score_lag1"]
    model = MD.make_pipeline(feats, [], MD.logistic("risk", max_iter=20)).fit(train)
    path = MD.save_bundle(model, SK.scratch_path(spark, "smoke-model"), feats, "risk", "binary")
    loaded, meta = MD.load_bundle(path)                                        # step 4: bundle loads
    assert meta["feature_cols"] == feats and meta["target"] == "risk"
    out = MD.score(loaded, train, ["user_id", "date"]).withColumnRenamed("p", "risk")   # step 5: predict
    rows = out.select("user_id", "date", "risk").collect()                     # step 6: output shape
    assert rows and all(r.user_id is not None and r.date is not None and 0.0 <= r.risk <= 1.0 for r in rows)
