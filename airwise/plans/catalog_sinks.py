"""Queries: sinks and upserts (SNK-01 .. SNK-11) as resulting-table states."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwise.operators import sinks as SK
from airwise.operators import windows as W
from airwise.plans.registry import query
from airwise.sources import tables as T

NOW = "2024-02-01 00:00:00"


def _old_new(spark, d):
    """Old table = supplier-days before 1999 plus even suppliers; new = 1998..1999 rows re-measured."""
    b = T.daily_big(spark, d).select("location_id", "date", "PM2_5_mean", "AQI", "pollen_tree")
    old = b.where((F.col("date") < "1999-01-01") | (F.col("location_id").cast("int") % 2 == 0))
    new = b.where(F.col("date").between("1998-01-01", "1999-12-31")).select(
        "location_id", "date",
        F.when(F.col("location_id").cast("int") % 3 == 0, F.col("PM2_5_mean")).otherwise(F.col("PM2_5_mean") + 1).alias("PM2_5_mean"),
        F.when(F.col("location_id").cast("int") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("AQI")).alias("AQI"),
        "pollen_tree")
    return old, new


OLD_NEW_SQL = """
b AS (SELECT location_id, date, PM2_5_mean, AQI, pollen_tree FROM daily_big),
old AS (SELECT * FROM b WHERE date < DATE '1999-01-01' OR CAST(location_id AS INTEGER) % 2 = 0),
new AS (SELECT location_id, date,
          CASE WHEN CAST(location_id AS INTEGER) % 3 = 0 THEN PM2_5_mean ELSE PM2_5_mean + 1 END AS PM2_5_mean,
          CASE WHEN CAST(location_id AS INTEGER) % 5 = 0 THEN NULL ELSE AQI END AS AQI, pollen_tree
        FROM b WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31')"""


@query("snk_03_upsert_replace", "WITH " + OLD_NEW_SQL + """
SELECT * FROM new
UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.location_id = o.location_id AND n.date = o.date)""",
       ["env_daily"])
def q_snk03(spark, d):
    """SNK-03: the new row fully replaces the old row of its (location_id, date)."""
    old, new = _old_new(spark, d)
    return SK.upsert_replace(old, new, ["location_id", "date"])


@query("snk_04_upsert_merge", "WITH " + OLD_NEW_SQL + """
SELECT coalesce(o.location_id, n.location_id) AS location_id, coalesce(o.date, n.date) AS date,
       CASE WHEN n.location_id IS NOT NULL THEN n.PM2_5_mean ELSE o.PM2_5_mean END AS PM2_5_mean,
       CASE WHEN n.location_id IS NOT NULL THEN n.AQI ELSE o.AQI END AS AQI,
       CASE WHEN n.location_id IS NOT NULL THEN n.pollen_tree ELSE o.pollen_tree END AS pollen_tree
FROM old o FULL OUTER JOIN new n ON o.location_id = n.location_id AND o.date = n.date""", ["daily_big"])
def q_snk04(spark, d):
    """SNK-04: bulk $set upsert (present new values win, others kept)."""
    old, new = _old_new(spark, d)
    table, _ = SK.upsert_merge(old, new, ["location_id", "date"])
    return table


@query("snk_04_upsert_count", "WITH " + OLD_NEW_SQL + """
SELECT count(*) FILTER (WHERE o.location_id IS NULL
   OR o.PM2_5_mean IS DISTINCT FROM n.PM2_5_mean OR o.AQI IS DISTINCT FROM n.AQI
   OR o.pollen_tree IS DISTINCT FROM n.pollen_tree) AS n_upserted
FROM new n LEFT JOIN old o ON o.location_id = n.location_id AND o.date = n.date""", ["daily_big"])
def q_snk04b(spark, d):
    """SNK-04: rows inserted + changed (a no-op update does not count)."""
    old, new = _old_new(spark, d)
    _, count = SK.upsert_merge(old, new, ["location_id", "date"])
    return count


@query("snk_05_upsert_pollen_struct", """
WITH b AS (SELECT location_id, date, pollen_tree, pollen_grass, pollen_weed FROM env_daily),
old AS (SELECT * FROM b WHERE day(date) <= 20),
new AS (SELECT location_id, date, pollen_tree * 2 AS tree_index, pollen_grass * 2 AS grass_index FROM b WHERE day(date) >= 15)
SELECT coalesce(o.location_id, n.location_id) AS location_id, coalesce(o.date, n.date) AS date,
       CASE WHEN n.location_id IS NOT NULL THEN n.tree_index ELSE o.pollen_tree END AS tree_index,
       CASE WHEN n.location_id IS NOT NULL THEN n.grass_index ELSE o.pollen_grass END AS grass_index,
       o.pollen_weed AS weed_index,
       CASE WHEN n.location_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE CAST(o.date AS TIMESTAMP) END AS ingestedAt
FROM old o FULL OUTER JOIN new n ON o.location_id = n.location_id AND o.date = n.date""", ["env_daily"])
def q_snk05(spark, d):
    """SNK-05: partial upsert of two fields of the nested pollen struct, ingestedAt stamped."""
    b = T.env_daily(spark, d)
    docs = b.select("location_id", "date",
                    F.struct(F.col("pollen_tree").alias("tree_index"), F.col("pollen_grass").alias("grass_index"),
                             F.col("pollen_weed").alias("weed_index")).alias("pollen"),
                    F.col("date").cast("timestamp").alias("ingestedAt"))
    old = docs.where(F.dayofmonth("date") <= 20)
    new = b.where(F.dayofmonth("date") >= 15).select("location_id", "date", (F.col("pollen_tree") * 2).alias("tree_index"),
                                                     (F.col("pollen_grass") * 2).alias("grass_index"))
    out = SK.upsert_columns(old, new, ["location_id", "date"], "pollen", ["tree_index", "grass_index"],
                            F.lit(NOW).cast("timestamp"))
    return out.select("location_id", "date", "pollen.tree_index", "pollen.grass_index", "pollen.weed_index",
                      F.col("ingestedAt").cast("timestamp_ntz").alias("ingestedAt"))


@query("snk_06_replace_by_key", """
WITH old AS (SELECT user_id, date, symptomScore FROM checkins),
new AS (SELECT user_id, date, symptomScore + 1 AS symptomScore FROM checkins WHERE user_id % 4 = 0 AND day(date) % 2 = 0)
SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new""", ["checkins"])
def q_snk06(spark, d):
    """SNK-06: all rows of a user replaced by the new label rows (delete + insert)."""
    c = T.checkins(spark, d).select("user_id", "date", "symptomScore")
    new = c.where((F.col("user_id") % 4 == 0) & (F.dayofmonth("date") % 2 == 0)) \
        .withColumn("symptomScore", F.col("symptomScore") + 1)
    return SK.replace_by_key(c, new, "user_id")


@query("snk_07_ag_13_append_checkins", """
WITH u AS (SELECT user_id FROM users),
cnt AS (SELECT user_id, count(*) AS n FROM checkins GROUP BY user_id)
SELECT u.user_id, CASE WHEN cnt.n IS NULL THEN NULL ELSE CAST(cnt.n AS INTEGER) END AS n_checkins,
       (SELECT min(strftime(date, '%Y-%m-%d')) FROM checkins c WHERE c.user_id = u.user_id) AS first_date,
       (SELECT max(strftime(date, '%Y-%m-%d')) FROM checkins c WHERE c.user_id = u.user_id) AS last_date
FROM u LEFT JOIN cnt ON cnt.user_id = u.user_id""", ["users", "checkins"])
def q_snk07(spark, d):
    """SNK-07 (+AJ-02): check-ins before the 16th nested per user, later ones appended; unknown users are a no-op."""
    c = T.checkins(spark, d)
    users = SK.nest_checkins(T.users(spark, d).select("user_id"), c.where(F.dayofmonth("date") < 16))
    new = c.where(F.dayofmonth("date") >= 16).select(
        "user_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "wheeze", "cough", "chestTightness", "exerciseMinutes")
    ghost = new.select((F.col("user_id") + 10_000_000).alias("user_id"), *[c for c in new.columns if c != "user_id"])
    out = SK.append_checkin(users, new.unionByName(ghost))
    return out.select("user_id",
                      F.when(F.col("checkIns").isNull(), F.lit(None).cast("int")).otherwise(F.size("checkIns")).alias("n_checkins"),
                      F.array_min(F.transform("checkIns", lambda x: x["date"])).alias("first_date"),
                      F.array_max(F.transform("checkIns", lambda x: x["date"])).alias("last_date"))


@query("snk_07_merge_checkins_by_day", """
WITH e AS (SELECT user_id, event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, ts, value / 100 AS exerciseMinutes,
             greatest(0, least(3, CAST(json_extract_string(props, '$.k') AS INTEGER) - 50)) AS wheeze, day(ts) AS d FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY (d >= 10) DESC, ts DESC, event_id DESC) AS i FROM e)
SELECT r.user_id, CAST(row_number() OVER (PARTITION BY r.user_id ORDER BY date) - 1 AS INTEGER) AS pos, date, wheeze, exerciseMinutes
FROM r JOIN (SELECT c_custkey AS user_id FROM customer) u ON r.user_id = u.user_id WHERE i = 1""", [])
def q_snk07_by_day(spark, d):
    """SNK-07: the whole arrays after a merge by day: records of the first half of the month are stored (the last of a
    day by time), then those from the 10th on arrive, several a day and for unknown users too; the last of a day replaces
    what is stored for it."""
    e = T.raw(spark, d, "events").select(
        "user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "ts", (F.col("value") / 100).alias("exerciseMinutes"),
        F.greatest(F.lit(0), F.least(F.lit(3), F.get_json_object("props", "$.k").cast("int") - 50)).alias("wheeze"))
    users = T.raw(spark, d, "customer").select(F.col("c_custkey").alias("user_id"),
                                               F.array().cast("array<struct<date:string,wheeze:int,exerciseMinutes:double>>").alias("checkIns"))
    first = SK.append_checkin(users, e.where(F.dayofmonth("ts") < 16), order=["ts", "event_id"])
    both = SK.append_checkin(first, e.where(F.dayofmonth("ts") >= 10), order=["ts", "event_id"])
    return both.select("user_id", F.posexplode("checkIns").alias("pos", "c")).select("user_id", "pos", "c.date", "c.wheeze", "c.exerciseMinutes")


def _stored_upsert(spark, d, how):
    """Stored: even locations, and all before the 20th; new: every third day of all locations, measured again."""
    b = T.env_daily(spark, d).select("location_id", "date", "PM2_5_mean", "AQI", "pollen_tree")
    old = b.where((F.col("location_id").cast("int") % 2 == 0) | (F.dayofmonth("date") < 20))
    new = b.where(F.dayofmonth("date") % 3 == 0).select(
        "location_id", "date", (F.col("PM2_5_mean") + 1).alias("PM2_5_mean"),
        F.when(F.col("location_id").cast("int") % 5 != 0, F.col("AQI")).alias("AQI"), "pollen_tree")
    path = SK.write_daily(old, SK.scratch_path(spark, f"upsert-{how}"))
    SK.upsert_partitions(spark, path, new, ["location_id", "date"], how)
    return spark.read.parquet(path).select(*old.columns)


_TOUCHED_SQL = """WITH b AS (SELECT location_id, date, PM2_5_mean, AQI, pollen_tree FROM env_daily),
old AS (SELECT * FROM b WHERE CAST(location_id AS INTEGER) % 2 = 0 OR day(date) < 20),
fresh AS (SELECT location_id, date, PM2_5_mean + 1 AS PM2_5_mean, CASE WHEN CAST(location_id AS INTEGER) % 5 <> 0 THEN AQI END AS AQI, pollen_tree
        FROM b WHERE day(date) % 3 = 0)"""


@query("snk_03_upsert_touched_partitions", _TOUCHED_SQL + """
SELECT * FROM fresh UNION ALL SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.location_id = o.location_id AND n.date = o.date)""",
       ["env_daily"])
def q_snk03_touched(spark, d):
    """SNK-03 on a stored table: the new rows replace theirs; days without new rows keep their files."""
    return _stored_upsert(spark, d, "replace")


@query("snk_04_merge_touched_partitions", _TOUCHED_SQL + """
SELECT coalesce(o.location_id, n.location_id) AS location_id, coalesce(o.date, n.date) AS date,
       CASE WHEN n.location_id IS NOT NULL THEN n.PM2_5_mean ELSE o.PM2_5_mean END AS PM2_5_mean,
       CASE WHEN n.location_id IS NOT NULL THEN n.AQI ELSE o.AQI END AS AQI,
       CASE WHEN n.location_id IS NOT NULL THEN n.pollen_tree ELSE o.pollen_tree END AS pollen_tree
FROM old o FULL OUTER JOIN fresh n ON o.location_id = n.location_id AND o.date = n.date""", ["env_daily"])
def q_snk04_touched(spark, d):
    """SNK-04 on a stored table: bulk $set of the touched days only."""
    return _stored_upsert(spark, d, "merge")


@query("snk_08_upsert_users", """
WITH old AS (SELECT * FROM users WHERE user_id % 3 <> 0),
new AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new-' || name END AS name,
               CAST(120 + user_id % 50 AS VARCHAR) || ' lbs' AS profile_weight FROM users WHERE user_id % 5 = 0)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.name, o.name) AS name,
       o.email AS email, o.profile_height AS height, coalesce(n.profile_weight, o.profile_weight) AS weight,
       CASE WHEN o.user_id IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS createdAt,
       CASE WHEN n.user_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updatedAt
FROM old o FULL OUTER JOIN new n ON o.user_id = n.user_id""", ["users"])
def q_snk08(spark, d):
    """SNK-08: user upsert (supplied fields only; profile merged field by field; createdAt once)."""
    u = T.users(spark, d)
    jan = F.lit("2024-01-01 00:00:00").cast("timestamp")
    old = u.where(F.col("user_id") % 3 != 0).withColumn("createdAt", jan).withColumn("updatedAt", jan)
    new = u.where(F.col("user_id") % 5 == 0).select(
        "user_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("new-"), F.col("name"))).alias("name"),
        F.struct(F.concat((120 + F.col("user_id") % 50).cast("string"), F.lit(" lbs")).alias("weight")).alias("profile"))
    out = SK.upsert_users(old, new, F.lit(NOW).cast("timestamp"))
    return out.select("user_id", "name", "email", F.col("profile.height").alias("height"),
                      F.col("profile.weight").alias("weight"),
                      F.col("createdAt").cast("timestamp_ntz").alias("createdAt"),
                      F.col("updatedAt").cast("timestamp_ntz").alias("updatedAt"))


@query("snk_09_save_predictions", """
WITH cache AS (SELECT user_id, date, symptomScore / 9 AS risk, TIMESTAMP '2024-01-15 00:00:00' AS updated_at
               FROM checkins WHERE user_id % 2 = 0),
preds AS (SELECT user_id, date, (symptomScore + 1) / 10 AS risk FROM checkins WHERE date >= DATE '2024-01-20')
SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.date, p.date) AS date,
       CASE WHEN p.user_id IS NOT NULL AND p.risk IS NOT NULL THEN p.risk ELSE c.risk END AS risk,
       CASE WHEN p.user_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE c.updated_at END AS updated_at
FROM cache c FULL OUTER JOIN preds p ON c.user_id = p.user_id AND c.date = p.date""", ["checkins"])
def q_snk09(spark, d):
    """SNK-09: predictions upserted into the (user_id, date) cache with updated_at."""
    c = T.checkins(spark, d)
    cache = c.where(F.col("user_id") % 2 == 0).select(
        "user_id", "date", (F.col("symptomScore") / 9).alias("risk"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("updated_at"))
    preds = c.where(F.col("date") >= "2024-01-20").select("user_id", "date", ((F.col("symptomScore") + 1) / 10).alias("risk"))
    out = SK.save_predictions(cache, preds, "risk", F.lit(NOW).cast("timestamp"))
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def _measured_twice(b):
    """Every row and a second one that measured 1 less, from one pass: a union would hold two rollups in each task."""
    pm = F.col("PM2_5_mean")
    return b.withColumn("PM2_5_mean", F.explode(F.array(pm, pm - 1)))


@query("snk_10_dedupe_and_write_daily", """
SELECT location_id, date, max(PM2_5_mean) AS PM2_5_mean FROM daily_big GROUP BY location_id, date""",
       ["daily_big"])
def q_snk10(spark, d):
    """SNK-10: duplicates removed on (location_id, date), written date-partitioned
    (dynamic overwrite) and read back."""
    dup = _measured_twice(T.daily_big(spark, d).select("location_id", "date", "PM2_5_mean"))
    clean = SK.dedupe_keys(dup, ["location_id", "date"], [F.col("PM2_5_mean").desc()])
    path = SK.scratch_path(spark, "daily")
    SK.write_daily(clean, path)
    return spark.read.parquet(path).select("location_id", "date", "PM2_5_mean")


@query("snk_01_02_11_aj_04_round_trips", """
SELECT location_id, strftime(date, '%Y-%m-%d') AS date, PM2_5_mean, risk_score FROM (
  SELECT location_id, date, PM2_5_mean,
         sround(CASE WHEN p < 0.2 THEN 1 + p * 5 WHEN p < 0.5 THEN 2 + (p - 0.2::DOUBLE) * 10 ELSE 4 + (p - 0.5::DOUBLE) * 2 END, 1) AS risk_score
  FROM (SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.15::DOUBLE + least(0.2::DOUBLE, coalesce(AQI, 0) / 400)
            + least(0.15::DOUBLE, coalesce(PM2_5_mean, 0) / 200)
            + least(0.1::DOUBLE, (coalesce(pollen_tree, 0) + coalesce(pollen_grass, 0) + coalesce(pollen_weed, 0)) / 80))) AS p
        FROM env_daily))""", ["env_daily"])
def q_snk01(spark, d):
    """SNK-01 (CSV with header), SNK-02/AJ-04 (JSON records of nested risk structs) and SNK-11 (text
    report in the order of location and date): written under the shared checkpoint folder and read back."""
    from airwise.functions import mathx as M
    e = T.env_daily(spark, d)
    p = M.rule_probability("AQI", "PM2_5_mean", M.pollen_total("pollen_tree", "pollen_grass", "pollen_weed"))
    rec = e.select("location_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "PM2_5_mean",
                   M.risk_struct(p).alias("risk"))
    jpath = SK.write_json(rec, SK.scratch_path(spark, "records"))
    cpath = SK.write_csv(e.select("location_id", "date", "PM2_5_mean"), SK.scratch_path(spark, "csv"))
    lines = W.row_index(rec.select("location_id", "date", F.to_json(F.struct("location_id", "date")).alias("value")),
                        [F.col("location_id"), F.col("date")], "line_no").select("line_no", "value")
    rpath = SK.write_report(lines, SK.scratch_path(spark, "report"))
    r = SK.read_report(spark, rpath).select(F.from_json("value", "location_id string, date string").alias("k")).select("k.*")
    j = spark.read.schema("location_id string, date string, PM2_5_mean double, "
                          "risk struct<score:double,level:string,label:string>").json(jpath)
    c = spark.read.option("header", True).schema("location_id string, date date, PM2_5_mean double").csv(cpath)
    return j.join(c.select("location_id", F.date_format("date", "yyyy-MM-dd").alias("date")), ["location_id", "date"]) \
        .join(r, ["location_id", "date"]) \
        .select("location_id", "date", "PM2_5_mean", F.col("risk.score").alias("risk_score"))
