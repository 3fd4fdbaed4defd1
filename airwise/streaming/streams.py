"""Structured Streaming jobs (SS-01 .. SS-03).

Sources are file streams over the landed parquet; sinks are parquet folders
plus streaming checkpoints under the shared ``spark.checkpoint.dir`` so a
restarted query resumes exactly where it stopped.  ``availableNow`` runs
each job to completion over what has landed, which is also how the batch
twins in the tests drive them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwise.functions import mathx as M
from airwise.operators import sinks as SK
from airwise.sources import tables as T

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", max_files: int = 1) -> DataFrame:
    """Landed event files of ``folder`` as a stream (schema given; never inferred on a stream)."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", pattern).parquet(folder))


def readings_stream(events: DataFrame) -> DataFrame:
    return events.select("event_id", T.location_of("user_id").alias("location_id"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("pm"),
                         F.col("event_type").alias("kind"))


def daily_rollup_stream(readings: DataFrame, delay: str = "2 days") -> DataFrame:
    """SS-01: hourly readings -> daily PM mean / max per location; readings later than
    the watermark are dropped, windows are emitted once the watermark passes them."""
    return (readings.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("w"), "location_id")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("pm").alias("PM2_5_mean"), F.max("pm").alias("PM2_5_max"))
            .select("location_id", F.to_date(F.col("w.start")).alias("date"), "n", "PM2_5_mean", "PM2_5_max"))


#: State on the executors' disks instead of their heaps; a commit uploads only what changed since the last one.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> str:
    """Run a streaming query over everything available, into parquet (fault tolerant).  ``conf`` holds
    settings for this query alone; the session's own come back when it has ended."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        q = (df.writeStream.outputMode(mode).format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out


def upsert_batches(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> str:
    """SS-02: continuous idempotent upsert of daily values.

    The state of a (key, day) is mergeable: count, sum and maximum.  A micro-batch asks the file
    system for the newest earlier batch of each day it touches (folder names are the manifest), reads exactly these
    folders, adds its own rows, and writes these days only, under its batch id (``date=<day>/batch=<id>``).
    What it reads does not grow with the days stored.  States of the same or a later batch are not read, so a
    retried batch overwrites its own files with the same content.  Afterwards folders older than the
    state it has read are deleted: a day holds two batches at most, the newest and the one that a retry needs.
    ``read_upserted`` takes each day's newest batch and derives the mean.  ``keys`` must hold ``date``."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(*keys).agg(F.count("pm").alias("n"), F.sum("pm").alias("total"), F.max("pm").alias("PM2_5_max"))
        days = [r[0] for r in batch.select("date").distinct().collect()]  # the calendar days of one micro-batch
        stored = {d: [b for b in _batches(spark, target, d) if b < batch_id] for d in days}
        paths = [f"{target}/{_folder(d)}/batch={max(b)}" for d, b in stored.items() if b]
        if paths:
            old = spark.read.option("basePath", target).parquet(*paths)
            new = old.select(*new.columns).unionByName(new).groupBy(*keys).agg(
                F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("PM2_5_max").alias("PM2_5_max"))
        new.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(target)
        for d, b in stored.items():
            for n in sorted(b)[:-1]:
                _path(spark, f"{target}/{_folder(d)}/batch={n}", delete=True)

    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return target


def _folder(day) -> str:
    return f"date={day if day is not None else '__HIVE_DEFAULT_PARTITION__'}"


def _path(spark: SparkSession, pattern: str, delete: bool = False) -> list[str]:
    """Paths that match, from Spark's own file system; with ``delete`` the path itself is removed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if delete:
        fs.delete(p, True)
        return []
    return [s.getPath().toString() for s in fs.globStatus(p) or []]


def _batches(spark: SparkSession, target: str, day) -> list[int]:
    """Batches stored for a day."""
    return [int(p.rsplit("=", 1)[1]) for p in _path(spark, f"{target}/{_folder(day)}/batch=*")]


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    """SS-02 table: keys, n, PM2_5_mean, PM2_5_max.  Only the newest batch folder of each day is read."""
    newest: dict[str, int] = {}
    for p in _path(spark, f"{target}/date=*/batch=*"):
        day, n = p.rsplit("/batch=", 1)
        newest[day] = max(int(n), newest.get(day, -1))
    table = spark.read.option("basePath", target).parquet(*[f"{day}/batch={n}" for day, n in newest.items()])
    return table.withColumn("PM2_5_mean", F.col("total") / F.col("n")).drop("total", "batch")


def _checkins(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
                         M.clamp_number(F.get_json_object("props", "$.k").try_cast("int") - 50, 0, 3).alias("wheeze"),
                         M.clamp_number(F.col("value") / 100, 0, 1440).alias("exerciseMinutes"))


def checkin_arrivals(events: DataFrame, days: int = 1) -> DataFrame:
    """SS-03, first by arrival: the first record of a (user, date) that comes in leaves at once, before its
    day closes, and later ones of that day are dropped.  State is one key per user and open day, run it with ``ROCKSDB``.

    With a delay of a day or more no double passes: the key of a record at t is kept until the watermark
    is beyond t + delay, which is after the end of its day, and from then on any other record of that day is late
    itself.  Which of the records of one micro-batch stays is open; ``checkin_stream`` takes the first by time
    and waits for it.  Rows without a time or user are check-ins of no one's day and are dropped."""
    if days < 1:
        raise ValueError("a delay below one day lets doubles of a day pass")
    c = _checkins(events).where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("date", F.to_date("ts"))
    return c.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["user_id", "date"])


def checkin_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """SS-03: check-in records clamped (MA-12); the first record per (user, date) by (time, event id)
    is kept.  The order is total, so neither arrival nor file order matters.  A day is emitted once
    the watermark passes its end; records later than that are dropped."""
    c = _checkins(events)
    record = F.struct("ts", "event_id", "wheeze", "exerciseMinutes")
    first = c.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.min(record).alias("r"))
    return first.select("user_id", F.to_date(F.col("w.start")).alias("date"), "r.event_id", "r.wheeze", "r.exerciseMinutes")


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    base = SK.scratch_path(spark, name)
    return f"{base}/out", f"{base}/_checkpoint"
