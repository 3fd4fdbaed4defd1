"""Queries: Structured Streaming jobs (SS-01 .. SS-03), each run to completion over the
landed event files and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.plans.registry import query
from airwise.sources import tables as T
from airwise.streaming import streams as SS


@query("ss_01_streaming_daily_rollup", """
WITH r AS (SELECT CAST(user_id % 10 + 10 * (user_id // 150) AS VARCHAR) AS location_id, ts, value AS pm FROM events),
cut AS (SELECT max(ts) - INTERVAL 2 DAY AS wm FROM events)
SELECT location_id, CAST(ts AS DATE) AS date, count(*) AS n, avg(pm) AS PM2_5_mean, max(pm) AS PM2_5_max
FROM r GROUP BY location_id, CAST(ts AS DATE)
HAVING CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT wm FROM cut)""", [])
def q_ss01(spark, d):
    """SS-01: watermark (2 days) + tumbling 1-day windows, append mode, parquet sink."""
    out, ck = SS.scratch(spark, "ss01")
    SS.run_to_parquet(SS.daily_rollup_stream(SS.readings_stream(SS.event_stream(spark, d))), out, ck)
    return spark.read.parquet(out)


@query("ss_02_streaming_idempotent_upsert", """
SELECT CAST(user_id % 10 + 10 * (user_id // 150) AS VARCHAR) AS location_id, CAST(ts AS DATE) AS date, count(value) AS n, avg(value) AS PM2_5_mean,
       max(value) AS PM2_5_max
FROM events GROUP BY 1, 2""", [])
def q_ss02(spark, d):
    """SS-02: foreachBatch upsert (SNK-04) of each micro-batch's daily rollup into the table."""
    out, ck = SS.scratch(spark, "ss02")
    r = SS.readings_stream(SS.event_stream(spark, d)).withColumn("date", F.to_date("ts"))
    return SS.read_upserted(spark, SS.upsert_batches(r, out, ck, ["location_id", "date"]))


@query("ss_03_streaming_checkin_dedupe", """
WITH c AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS date,
             greatest(0, least(3, CAST(json_extract_string(props, '$.k') AS INTEGER) - 50)) AS wheeze,
             greatest(0.0, least(1440.0, value / 100)) AS exerciseMinutes,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, date, event_id, CAST(wheeze AS DOUBLE) AS wheeze, CAST(exerciseMinutes AS DOUBLE) AS exerciseMinutes FROM c
WHERE i = 1 AND CAST(date + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""", [])
def q_ss03(spark, d):
    """SS-03: clamped check-ins, first record per (user, date) by time, emitted behind the watermark."""
    out, ck = SS.scratch(spark, "ss03")
    SS.run_to_parquet(SS.checkin_stream(SS.event_stream(spark, d)), out, ck)
    return spark.read.parquet(out).select("user_id", "date", "event_id", F.col("wheeze").cast("double").alias("wheeze"),
                                          F.col("exerciseMinutes").cast("double").alias("exerciseMinutes"))


@query("ss_03_streaming_checkin_arrivals", """
SELECT user_id, CAST(ts AS DATE) AS date, CAST(1 AS BIGINT) AS n, true AS of_that_day
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""", [])
def q_ss03_arrivals(spark, d):
    """SS-03: one check-in per (user, date), the first to arrive, joined back to its event: it is an event of that user and day."""
    out, ck = SS.scratch(spark, "ss03-arrivals")
    SS.run_to_parquet(SS.checkin_arrivals(SS.event_stream(spark, d)), out, ck, conf=SS.ROCKSDB)
    kept = spark.read.parquet(out)
    events = T.raw(spark, d, "events").select("event_id", F.col("user_id").alias("u"), F.to_date("ts").alias("day"))
    return kept.join(events, "event_id").groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((F.col("u") == F.col("user_id")) & (F.col("day") == F.col("date"))).alias("of_that_day"))
