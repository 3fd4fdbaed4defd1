"""Streaming jobs over files that land in two steps: late data and idempotent upserts."""

import tempfile

from pyspark.sql import functions as F

from airwise.streaming import streams as SS
from tests.conftest import SMALL


def _land(spark, folder, df, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_staging_{name}")
    # move the single part file into the watched folder under an events*.parquet name
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src_dir = jvm.org.apache.hadoop.fs.Path(f"{folder}/_staging_{name}")
    fs = src_dir.getFileSystem(conf)
    part = [s.getPath() for s in fs.listStatus(src_dir) if s.getPath().getName().startswith("part-")][0]
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/events_{name}.parquet"))


def test_watermark_drops_late_readings(spark):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="airwise-stream-")
    out, ck = SS.scratch(spark, "t-ss01")
    _land(spark, folder, ev.where(F.dayofmonth("ts") >= 2), "a")
    SS.run_to_parquet(SS.daily_rollup_stream(SS.readings_stream(SS.event_stream(spark, folder))), out, ck)
    first = spark.read.parquet(out).count()
    # readings of day 1 arrive after the watermark (max ts - 2 days) passed them: dropped
    _land(spark, folder, ev.where(F.dayofmonth("ts") == 1), "b")
    SS.run_to_parquet(SS.daily_rollup_stream(SS.readings_stream(SS.event_stream(spark, folder))), out, ck)
    res = spark.read.parquet(out)
    assert res.count() == first
    assert res.where(F.dayofmonth("date") == 1).count() == 0


def test_foreach_batch_upsert_merges_days_and_is_idempotent(spark):
    """Every day is split over three files (so over three micro-batches): mean, maximum and count equal
    those of the batch twin; a second run changes nothing, and a batch writes only the days it touches."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="airwise-stream-")
    out, ck = SS.scratch(spark, "t-ss02")

    def run():
        r = SS.readings_stream(SS.event_stream(spark, folder)).withColumn("date", F.to_date("ts"))
        return SS.read_upserted(spark, SS.upsert_batches(r, out, ck, ["location_id", "date"]))

    def rows(df):
        return {(r["location_id"], r["date"]): (r["n"], round(r["PM2_5_mean"], 9), r["PM2_5_max"]) for r in df.collect()}

    for k in range(3):
        _land(spark, folder, ev.where(F.col("event_id") % 3 == k), f"p{k}")
        run()
    table = rows(run())  # nothing new
    want = ev.groupBy((F.col("user_id") % 10).cast("string").alias("location_id"), F.to_date("ts").alias("date")) \
        .agg(F.count("value").alias("n"), F.avg("value").alias("PM2_5_mean"), F.max("value").alias("PM2_5_max"))
    assert table == rows(want)
    day = ev.agg(F.min(F.to_date("ts"))).first()[0]
    _land(spark, folder, ev.where(F.to_date("ts") == F.lit(day)), "again")
    before = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    run()
    later = spark.read.parquet(out).where(F.col("batch") > before)
    assert [r[0] for r in later.select("date").distinct().collect()] == [day]


def test_a_batch_reads_only_the_days_it_touches(spark):
    """Files read by a later batch don't grow with the days stored, old batches go, and a retry changes nothing."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="airwise-stream-")
    out, ck = SS.scratch(spark, "t-ss02-days")
    days = [r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]

    def run(checkpoint):
        r = SS.readings_stream(SS.event_stream(spark, folder)).withColumn("date", F.to_date("ts"))
        SS.upsert_batches(r, out, checkpoint, ["location_id", "date"])

    for k in range(4):  # everything in four batches, then one day three times
        _land(spark, folder, ev.where(F.col("event_id") % 4 == k), f"p{k}")
        run(ck)
    for k in range(3):
        _land(spark, folder, ev.where(F.to_date("ts") == F.lit(days[0])), f"q{k}")
        run(ck)
    assert all(1 <= len(SS._batches(spark, out, d)) <= 2 for d in days)
    assert max(SS._batches(spark, out, days[0])) == 6 and max(SS._batches(spark, out, days[1])) == 3
    table = {(r["location_id"], r["date"]): r["n"] for r in SS.read_upserted(spark, out).collect()}
    one = ev.where(F.to_date("ts") == F.lit(days[0])).count()
    assert sum(n for (_, d), n in table.items() if d == days[0]) == 4 * one and sum(table.values()) == ev.count() + 3 * one
    read = []
    original = spark.read.__class__.parquet
    try:
        spark.read.__class__.parquet = lambda self, *p, **kw: read.extend(p) or original(self, *p, **kw)
        _land(spark, folder, ev.where(F.to_date("ts") == F.lit(days[1])), "r")
        run(ck)
    finally:
        spark.read.__class__.parquet = original
    assert [p for p in read if p.startswith(out)] == [f"{out}/date={days[1]}/batch=3"]


def test_checkins_keep_the_first_by_time(spark):
    """The first record of a user's day wins whatever file it comes in."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="airwise-stream-")
    _land(spark, folder, ev.where(F.col("event_id") % 2 == 0), "b")
    _land(spark, folder, ev.where(F.col("event_id") % 2 == 1), "a")
    out, ck = SS.scratch(spark, "t-ss03")
    SS.run_to_parquet(SS.checkin_stream(SS.event_stream(spark, folder, max_files=10)), out, ck)
    got = {(r["user_id"], r["date"]): r["event_id"] for r in spark.read.parquet(out).collect()}
    want = ev.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", "date", "x.event_id")
    known = {(r["user_id"], r["date"]): r["event_id"] for r in want.collect()}
    assert got and all(known[k] == v for k, v in got.items())


def test_first_checkin_leaves_at_once_and_doubles_over_files_are_dropped(spark):
    """Every user's days are split over three files in three runs: a day's record is out after the first run, while
    the day is open, later doubles change nothing, and what comes after the watermark passed its day is dropped."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = tempfile.mkdtemp(prefix="airwise-stream-")
    out, ck = SS.scratch(spark, "t-ss03-arrivals")
    last = ev.agg(F.max(F.to_date("ts"))).first()[0]
    first = ev.agg(F.min(F.to_date("ts"))).first()[0]
    body = ev.where(F.to_date("ts") > F.lit(first))

    def run():
        SS.run_to_parquet(SS.checkin_arrivals(SS.event_stream(spark, folder)), out, ck, conf=SS.ROCKSDB)
        return {(r["user_id"], r["date"]): r["event_id"] for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    open_days = body.where(F.to_date("ts") >= F.date_sub(F.lit(last), 1))
    _land(spark, folder, open_days.where("event_id % 3 = 0"), "a")
    one, n = run()
    assert n == len(one) and any(day == last for _, day in one)
    for k in (1, 2):
        _land(spark, folder, open_days.where(f"event_id % 3 = {k}"), f"b{k}")
        table, n = run()
        assert n == len(table)
        assert all(table[key] == i for key, i in one.items())
    keys = {(r["user_id"], r["d"]) for r in open_days.select("user_id", F.to_date("ts").alias("d")).distinct().collect()}
    late = {k for k in keys if k not in table}
    assert set(table) <= keys and not any(day == last for _, day in late)
    _land(spark, folder, ev.where(F.to_date("ts") == F.lit(first)), "late")
    assert run()[0] == table
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != SS.ROCKSDB["spark.sql.streaming.stateStore.providerClass"]
