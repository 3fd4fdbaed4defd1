"""Upserts on stored tables: untouched partitions keep their files; check-ins merge by day."""

import pytest
from pyspark.sql import functions as F

from airwise.operators import sinks as SK

ROWS = "location_id string, date date, x double, y double"


def _files(spark, path):
    found = spark.read.parquet(path).select("date", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    out = {}
    for r in found.collect():
        out.setdefault(str(r.date), set()).add((r.p, r.t))
    return out


@pytest.mark.parametrize("how", ["replace", "merge", "delete_insert"])
def test_untouched_partitions_keep_their_files(spark, how):
    old = spark.range(400).select((F.col("id") % 20).cast("string").alias("location_id"),
                                  F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 20).cast("int")).alias("date"),
                                  F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    path = SK.write_daily(old, SK.scratch_path(spark, "t-upsert"))
    new = old.where("date = '2024-01-05' AND x % 2 = 0").select("location_id", "date", (-F.col("x")).alias("x"), F.lit(None).cast("double").alias("y")) \
        .unionByName(spark.createDataFrame([("new", None, 5.0, 6.0)], ROWS).withColumn("date", F.lit("2024-02-01").cast("date")))
    if how == "merge":
        new = new.drop("y")
    before = _files(spark, path)
    keys = ["location_id", "date"]
    assert SK.upsert_partitions(spark, path, new, keys, how) == 2
    after = _files(spark, path)
    assert {d: f for d, f in after.items() if d not in ("2024-01-05", "2024-02-01")} == {d: f for d, f in before.items() if d != "2024-01-05"}
    want = SK.upsert_merge(old, new, keys)[0] if how == "merge" else SK.upsert_replace(old, new, keys)
    rows = lambda df: sorted(map(tuple, df.select("location_id", "date", "x", "y").collect()), key=repr)
    assert rows(spark.read.parquet(path)) == rows(want)
    SK.upsert_partitions(spark, path, new, keys, how)  # again: nothing changes
    assert rows(spark.read.parquet(path)) == rows(want)
    assert SK.upsert_partitions(spark, path, new.limit(0), keys, how) == 0


def test_checkins_merge_by_day(spark):
    """The last record of a day by the given order stays, a stored day is replaced, double stored days are mended, unknown users ignored."""
    record = "struct<date:string,wheeze:int>"
    users = spark.sql(f"""SELECT 1 AS user_id, CAST(array(named_struct('date', '2024-01-01', 'wheeze', 1), named_struct('date', '2024-01-02', 'wheeze', 3),
        named_struct('date', '2024-01-02', 'wheeze', 2)) AS array<{record}>) AS checkIns UNION ALL SELECT 2, CAST(null AS array<{record}>) UNION ALL
        SELECT 3, CAST(array(named_struct('date', '2024-01-09', 'wheeze', 0)) AS array<{record}>)""")
    new = spark.createDataFrame([(1, "2024-01-03", 3, 10), (1, "2024-01-03", 0, 20), (1, "2024-01-01", 2, 5), (2, "2024-01-04", 1, 1), (9, "2024-01-01", 1, 1)],
                                "user_id int, date string, wheeze int, at int")
    once = SK.append_checkin(users, new, order=["at"])
    show = lambda df: {r.user_id: None if r.checkIns is None else [tuple(c) for c in r.checkIns] for r in df.collect()}
    want = {1: [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 0)], 2: [("2024-01-04", 1)], 3: [("2024-01-09", 0)]}
    assert show(once) == want and show(SK.append_checkin(once, new, order=["at"])) == want
