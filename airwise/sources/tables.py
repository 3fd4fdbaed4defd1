"""Engine tables derived from the landed parquet tables.

The engine works on environmental / user tables (SURVEY §1); the landed data
set is a star schema, so each engine table is a Spark view over it whose
size grows with the input (SURVEY §7.3).  Every builder takes
``(spark, sf_dir)`` and returns a lazy DataFrame: nothing is collected, and
column pruning / filter push-down reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airwise.functions import dates as D
from airwise.functions import mathx as M

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating column at read time (pandas treats them alike, Spark
    does not: NaN sorts above every number and wins ``max``)."""
    cols = [F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    return df.select(*cols)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table as is (no projection in front of the scan, so filters on its
    columns are pushed into the parquet reader)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _calendar_cols(date_col: str = "date"):
    d = F.col(date_col)
    return [D.weekday_name(d).alias("day_of_week"), F.month(d).alias("month"),
            D.season_name(F.month(d)).alias("season"), D.is_us_holiday(d).alias("holiday_flag")]


def location_of(user: str):
    """A user's location: ten locations for every 150 users, so places grow with the data."""
    u = F.col(user)
    return (u % 10 + 10 * F.floor(u / 150)).cast("string")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sensor readings: one row per event, at the location of its user."""
    ev = raw(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        location_of("user_id").alias("location_id"),
        "user_id",
        "ts",
        F.to_date("ts").alias("date"),
        F.col("value").alias("pm"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),  # dirty text -> null, not a failed job
    )


def env_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical daily table (21 columns) rolled up from the readings.

    Dense: ten locations for every 150 users, 30 days.  The rollup is a hash aggregate with a
    map-side partial step, so a hot location costs one partial row per task.
    """
    r = readings(spark, sf_dir)
    loc = F.col("location_id").cast("int")
    agg = r.groupBy("location_id", "date").agg(
        F.avg("pm").alias("PM2_5_mean"),
        F.max("pm").alias("PM2_5_max"),
        (F.max("k") * 2.0).alias("AQI"),
        (F.min("k") / 4.0 - 5).alias("temp_min"),
        (F.max("k") / 4.0).alias("temp_max"),
        F.avg("k").cast("double").alias("humidity"),
        (F.count(F.lit(1)) / 10.0).alias("wind"),
        (101000 + F.avg("k") * 10).alias("pressure"),
        (F.coalesce(F.sum(F.when(F.col("kind") == "error", F.col("pm"))), F.lit(0.0)) / 100).alias("rain"),
        (F.max(F.when(F.col("kind") == "click", F.col("pm"))) / 40).alias("pollen_tree"),
        (F.max(F.when(F.col("kind") == "view", F.col("pm"))) / 40).alias("pollen_grass"),
        (F.max(F.when(F.col("kind") == "purchase", F.col("pm"))) / 40).alias("pollen_weed"),
    )
    return agg.select(
        "location_id",
        (30.0 + loc % 10 + F.floor(loc / 10) * 0.0001).alias("latitude"),
        (-120.0 - loc % 10 - F.floor(loc / 10) * 0.0001).alias("longitude"),
        F.when(loc % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("9410"), F.col("location_id"))).alias("zip_code"),
        "date", "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind",
        "pressure", "rain", "pollen_tree", "pollen_grass", "pollen_weed",
        *_calendar_cols(),
    )


def daily_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical daily table at scale: one row per (supplier, ship day), with gaps."""
    li = raw(spark, sf_dir, "lineitem")
    agg = li.groupBy(F.col("l_suppkey"), F.to_date("l_shipdate").alias("date")).agg(
        F.avg("l_quantity").alias("PM2_5_mean"),
        F.max("l_quantity").alias("PM2_5_max"),
        (F.max("l_extendedprice") / 700).alias("AQI"),
        (F.min("l_tax") * 400 - 5).alias("temp_min"),
        (F.max("l_tax") * 400 + 5).alias("temp_max"),
        (F.avg("l_tax") * 1000).alias("humidity"),
        (F.avg("l_discount") * 100).alias("wind"),
        (100000 + F.max("l_linenumber") * 200.0).alias("pressure"),
        (F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(0.0)) * 10).alias("rain"),
        (F.max(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))) / 5).alias("pollen_tree"),
        (F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))) / 5).alias("pollen_grass"),
        (F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))) / 5).alias("pollen_weed"),
    )
    k = F.col("l_suppkey")
    return agg.select(
        k.cast("string").alias("location_id"),
        (24 + k % 27).cast("double").alias("latitude"),
        (-125 + k % 59).cast("double").alias("longitude"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.lpad(k.cast("string"), 5, "9")).alias("zip_code"),
        "date", "PM2_5_mean", "PM2_5_max", "AQI", "temp_min", "temp_max", "humidity", "wind",
        "pressure", "rain", "pollen_tree", "pollen_grass", "pollen_weed",
        *_calendar_cols(),
    )


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily symptom check-ins per (user, day) derived from the event stream."""
    ev = raw(spark, sf_dir, "events")
    t = F.col("event_type")
    cents = F.when(t == "purchase", F.round(F.col("value") * 100).cast("long"))
    agg = ev.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.count_if(t == "error").alias("n_err"),
        F.count_if(t == "click").alias("n_click"),
        F.count_if(t == "view").alias("n_view"),
        F.coalesce(F.sum(cents), F.lit(0)).alias("cents"),
        (F.count_if(t == "signup") > 0).alias("rescueUsed"),
    )
    wheeze = F.least(F.lit(3), F.col("n_err")).cast("int")
    cough = F.least(F.lit(3), F.col("n_click")).cast("int")
    chest = F.least(F.lit(3), F.col("n_view")).cast("int")
    return agg.select(
        "user_id", "date",
        wheeze.alias("wheeze"), cough.alias("cough"), chest.alias("chestTightness"),
        F.least(F.lit(1440), F.floor(F.col("cents") / 100)).cast("int").alias("exerciseMinutes"),
        "rescueUsed",
        (wheeze + cough + chest).cast("double").alias("symptomScore"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User profiles (one per customer) with text height/weight as entered."""
    c = raw(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    height = F.concat((4 + k % 3).cast("string"), F.lit("'"), (k % 12).cast("string"), F.lit('"'))
    weight = F.concat((110 + k % 120).cast("string"), F.lit(" lbs"))
    return c.select(
        k.alias("user_id"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com"))).alias("email"),
        F.col("c_name").alias("name"),
        F.when(k % 7 == 0, F.lit("")).otherwise((k % 10 + 10 * F.floor(k / 1500)).cast("string")).alias("location"),
        F.struct(
            F.col("c_name").alias("name"),
            height.alias("height"),
            weight.alias("weight"),
            F.when(k % 2 == 0, "female").otherwise("male").alias("gender"),
            F.when(k % 4 == 0, "smoker").otherwise("non-smoker").alias("smokerStatus"),
            F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "yes").otherwise("no").alias("petExposure"),
        ).alias("profile"),
    )


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily search-trend proxy: orders per order date."""
    o = raw(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores: y = quality, y_toxic = toxic, p = min(1, n_chars / 20000)."""
    lab = raw(spark, sf_dir, "labels")
    doc = raw(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(doc, "doc_id", "inner").select(
        "doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y_toxic"),
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("p"), "lang", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings")


def pollen_total_col():
    return M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed")
