"""Compiled ensembles against the models' own scores."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from airwise.operators import ensembles as EN
from airwise.operators import models as MD
from airwise.operators.sinks import scratch_path


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(1500).select(
        "id", F.when(F.col("id") % 41 == 0, None).otherwise(F.sin(F.col("id") * 1.0) * 10).alias("a"), (F.col("id") * 37 % 101).cast("double").alias("b"),
        F.element_at(F.array(*[F.lit(x) for x in ("fall", "spring", "summer", "winter")]), (F.col("id") % 4 + 1).cast("int")).alias("season"),
        ((F.col("id") * 37 % 101 > 50) & (F.col("id") % 4 < 2) | (F.col("id") % 13 == 0)).cast("double").alias("y"),
        (F.col("id") * 37 % 101 / 34).cast("int").cast("double").alias("c"))


@pytest.mark.parametrize("name", ["boosted", "forest"])
def test_compiled_scores_equal_the_models(spark, frame, name):
    est = MD.gbt("y", max_depth=3, max_iter=8) if name == "boosted" else MD.random_forest("c", n_trees=7, max_depth=4)
    full = frame.na.fill(0.0, ["a"])
    model = MD.make_pipeline(["a", "b"], ["season"], est).fit(full.where("season <> 'winter'"))  # winter is unseen
    bundle = EN.load(EN.save(EN.from_pipeline(model, scratch_path(spark, "t-trees"), {"target": "y"}), scratch_path(spark, "t-bundle")))
    assert bundle.kind == name and bundle.meta == {"target": "y"} and set(EN.used_columns(bundle)) <= {"a", "b", "season"}
    own = model.transform(full).select("id", vector_to_array("probability").alias("want"), F.col("prediction").cast("int").alias("label"))
    both = EN.score(bundle, full, ["id"]).join(own, "id").collect()
    assert len(both) == 1500
    for r in both:
        assert r.prediction == r.label and max(abs(x - y) for x, y in zip(r.probs, r.want)) < 1e-12 and len(r.probs) == len(r.want)


def test_scoring_reads_only_split_columns(spark, frame):
    path = scratch_path(spark, "t-frame")
    frame.write.parquet(path)
    bundle = EN.Bundle("boosted", ["a", "b"], {}, [(0, 0, 1, 50.0, None, 1, 2, None, 1.0), (0, 1, None, None, None, None, None, [-0.5], 1.0),
                                                  (0, 2, None, None, None, None, None, [0.5], 1.0)], {})
    out = EN.score(bundle, spark.read.parquet(path), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,b:double>" in plan and "Python" not in plan


def test_null_goes_right(spark):
    bundle = EN.Bundle("boosted", ["a"], {}, [(0, 0, 0, 5.0, None, 1, 2, None, 1.0), (0, 1, None, None, None, None, None, [-1.0], 1.0),
                                             (0, 2, None, None, None, None, None, [1.0], 1.0)], {})
    got = EN.score(bundle, spark.createDataFrame([(1, None), (2, 5.0), (3, 5.1)], "id int, a double"), ["id"]).orderBy("id").collect()
    assert [r.prediction for r in got] == [1, 0, 1]
