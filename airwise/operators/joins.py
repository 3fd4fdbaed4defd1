"""Joins (JN-01 .. JN-18).

Strategy is left to Catalyst + AQE: equi-joins plan as sort-merge or, when
the runtime size of one side is under the broadcast threshold, as a
broadcast hash join; AQE splits skewed partitions of a hot key.  Explicit
``broadcast`` hints are only used on tables whose size is fixed by
construction (the 12-month pollen calendar, one-row aggregates).  No join
here is a cross join: "every user x every forecast day" is generated per
user row with ``explode`` over the (bounded) list of forecast days.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airwise.functions.strings import ws_trim

from airwise.functions import mathx as M


def join_weather_air(weather: DataFrame, air: DataFrame, keys: Sequence[str] = ("location_id", "date")) -> DataFrame:
    """JN-01: full outer equi-join of the daily weather and air tables."""
    return weather.join(air, list(keys), "full")


def join_trends(env: DataFrame, trends: DataFrame, key: str = "date") -> DataFrame:
    """JN-02: env left join trends on date (trends hold one row per day)."""
    return env.join(trends, key, "left")


def load_merged(checkins: DataFrame, env: DataFrame, location: str | None = None,
                loc_col: str = "location_id") -> DataFrame:
    """JN-03: check-ins left join env on date only (fans out over locations
    unless a location is given); clashing env columns get the suffix _env.
    The schema is the same when env is empty: its columns are then null."""
    if location is not None:
        env = env.where(F.col(loc_col) == location)
    env = env.drop(loc_col)
    clash = (set(checkins.columns) & set(env.columns)) - {"date"}
    env = env.select(*[F.col(c).alias(c + "_env" if c in clash else c) for c in env.columns])
    return checkins.join(env, "date", "left")


def join_last_env(checkins: DataFrame, env: DataFrame, order: str = "ingestedAt", key: str = "date") -> DataFrame:
    """JN-04: inner lookup join where the last env row per date (by ``order``) wins."""
    last = env.groupBy(key).agg(F.max_by(F.struct(*[c for c in env.columns if c != key]), F.col(order)).alias("_e"))
    return checkins.join(last, key, "inner").select(*checkins.columns,
                                                   *[F.col(f"_e.{c}").alias(c) for c in env.columns
                                                     if c != key and c not in checkins.columns])


def users_x_dates(users: DataFrame, dates: Sequence, col: str = "date") -> DataFrame:
    """JN-05: each user times each requested date.  ``dates`` is the forecast
    window (next N days), a bounded list; rows are generated per user by
    ``explode`` so no cross join is planned."""
    arr = F.array(*[F.lit(d).cast("date") for d in dates])
    return users.select("*", F.explode(arr).alias(col))


def join_profile(df: DataFrame, profile: DataFrame, key: str = "user_id") -> DataFrame:
    """JN-06: left join the widened profile on the user."""
    return df.join(profile, key, "left")


def join_checkins(df: DataFrame, checkins: DataFrame, keys: Sequence[str] = ("user_id", "date"),
                  cols: Sequence[str] = ("wheeze", "cough", "chestTightness", "exerciseMinutes")) -> DataFrame:
    """JN-07: left join check-ins on (user, date); missing symptoms -> 0."""
    j = df.join(checkins.select(*keys, *cols), list(keys), "left")
    return j.na.fill(0, subset=list(cols))


def join_labels(env: DataFrame, labels: DataFrame, key: str | Sequence[str] = "date") -> DataFrame:
    """JN-08: inner join env x labels on date (or on (location, date) for many series)."""
    return env.join(labels, key if isinstance(key, str) else list(key), "inner")


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: Sequence[str] = ("user_id", "date")) -> DataFrame:
    """JN-09: requested pairs absent from the cache (left anti join)."""
    return wanted.select(*keys).join(cache.select(*keys), list(keys), "left_anti")


def cache_is_complete(wanted: DataFrame, cache: DataFrame, keys: Sequence[str] = ("user_id", "date")) -> bool:
    """JN-09: all-or-nothing test: any missing pair means a miss for all (limit-1 job)."""
    return cache_misses(wanted, cache, keys).isEmpty()


def cached_rows(cache: DataFrame, users: DataFrame, dates: DataFrame, user: str = "user_id",
                date: str = "date") -> DataFrame:
    """JN-10: cached rows of the requested users and dates (two left-semi joins)."""
    return cache.join(users.select(user), user, "left_semi").join(dates.select(date), date, "left_semi")


def override_scores(pred: DataFrame, no_symptom_users: DataFrame, env_scores: DataFrame, score: str = "score",
                    user: str = "user_id", date: str = "date", keys: Sequence[str] | None = None) -> DataFrame:
    """JN-11: users without symptoms take the env-only score of the date (of their
    location when ``keys`` = (location, date)) when one exists."""
    k = list(keys) if keys else [date]
    j = (pred.join(no_symptom_users.select(user, "no_symptoms"), user, "left")
             .join(env_scores.select(*k, F.col(score).alias("_env_score")), k, "left"))
    new = F.when(F.coalesce(F.col("no_symptoms"), F.lit(False)) & F.col("_env_score").isNotNull(),
                 F.col("_env_score")).otherwise(F.col(score))
    return j.withColumn(score, new).drop("_env_score", "no_symptoms")


def match_or_last(wanted: DataFrame, env: DataFrame, key: str = "location_id", date: str = "date") -> DataFrame:
    """JN-12: the env row of the exact date, else the last row of that location.
    The 'last row' side is one row per location (max_by), so it stays small."""
    vals = [c for c in env.columns if c not in (key, date)]
    exact = env.select(key, date, F.struct(*vals).alias("_x"))
    last = env.groupBy(key).agg(F.max_by(F.struct(*vals), F.col(date)).alias("_l"))
    j = wanted.join(exact, [key, date], "left").join(last, key, "left")
    return j.select(*wanted.columns, F.col("_x").isNotNull().alias("exact_match"),
                    *[F.when(F.col("_x").isNotNull(), F.col(f"_x.{c}")).otherwise(F.col(f"_l.{c}")).alias(c)
                      for c in vals])


def match_or_synthetic(wanted: DataFrame, env: DataFrame, synth: DataFrame, key: str = "location_id",
                       date: str = "date") -> DataFrame:
    """JN-13: exact date match, else the generated (ST-04) row for that date."""
    vals = [c for c in env.columns if c not in (key, date) and c in synth.columns]
    e = env.select(key, date, F.struct(*vals).alias("_x"))
    s = synth.select(key, date, F.struct(*vals).alias("_s"))
    j = wanted.join(e, [key, date], "left").join(s, [key, date], "left")
    return j.select(*wanted.columns, F.col("_x").isNotNull().alias("from_store"),
                    *[F.when(F.col("_x").isNotNull(), F.col(f"_x.{c}")).otherwise(F.col(f"_s.{c}")).alias(c)
                      for c in vals])


def alerts(users: DataFrame, risk: DataFrame, tomorrow, default_location: str, loc_col: str = "location",
           risk_loc: str = "location_id") -> DataFrame:
    """JN-14: each user with tomorrow's risk of their location (blank -> default)."""
    u = users.withColumn("alert_location",
                         F.coalesce(F.nullif(ws_trim(F.col(loc_col)), F.lit("")), F.lit(default_location)))
    r = risk.where(F.col("date") == F.lit(tomorrow).cast("date")).withColumnRenamed(risk_loc, "alert_location")
    return u.join(r, "alert_location", "inner")


def near_pairs(points: DataFrame, sensors: DataFrame, r_km: float, lat: str = "latitude", lon: str = "longitude",
               s_lat: str = "s_lat", s_lon: str = "s_lon") -> DataFrame:
    """JN-15: every (point, sensor) with the sensor inside the point's box of radius r.

    Range join as a grid equi-join: sensors fall into one square cell of
    side r/111 degrees; each point expands to the cells its box overlaps
    (a bounded count: at most ~2/max(cos(lat), 0.01) + 3 per axis), then the
    exact box test is the residual filter."""
    cell = r_km / 111.0
    dlat = F.lit(r_km / 111.0)
    dlon = F.lit(r_km) / (111.0 * F.greatest(F.cos(F.radians(F.col(lat))), F.lit(0.01)))
    p = points.select("*",
                      F.explode(F.sequence(F.floor((F.col(lat) - dlat) / cell).cast("long"),
                                           F.floor((F.col(lat) + dlat) / cell).cast("long"))).alias("_clat"))
    p = p.select("*", F.explode(F.sequence(F.floor((F.col(lon) - dlon) / cell).cast("long"),
                                           F.floor((F.col(lon) + dlon) / cell).cast("long"))).alias("_clon"))
    s = sensors.select("*", F.floor(F.col(s_lat) / cell).cast("long").alias("_clat"),
                       F.floor(F.col(s_lon) / cell).cast("long").alias("_clon"))
    j = p.join(s, ["_clat", "_clon"], "inner")
    hit = (F.col(s_lat).between(F.col(lat) - dlat, F.col(lat) + dlat)
           & F.col(s_lon).between(F.col(lon) - dlon, F.col(lon) + dlon))
    return j.where(hit).drop("_clat", "_clon")


# Regional pollen calendar, month 1..12 -> (tree, grass, weed) index.
POLLEN_CALENDAR = [
    (1, 4, 0, 0), (2, 4, 0, 0), (3, 4, 1, 0), (4, 4, 2, 0), (5, 3, 4, 0), (6, 2, 4, 1),
    (7, 2, 3, 2), (8, 2, 2, 3), (9, 2, 1, 4), (10, 1, 0, 4), (11, 1, 0, 2), (12, 3, 0, 0),
]


def pollen_calendar(spark: SparkSession) -> DataFrame:
    """The calendar as a 24-row dimension (two regions share one calendar)."""
    rows = [(r, m, float(t), float(g), float(w)) for r in ("US", "US_South") for m, t, g, w in POLLEN_CALENDAR]
    return spark.createDataFrame(rows, "region string, month int, tree_index double, grass_index double, weed_index double")


def join_pollen_calendar(df: DataFrame, lat: str = "latitude", lon: str = "longitude", date: str = "date") -> DataFrame:
    """JN-16: calendar pollen by (region, month); outside the regions -> no match (nulls)."""
    cal = pollen_calendar(df.sparkSession)
    keyed = df.withColumn("region", M.pollen_region(lat, lon)).withColumn("_m", F.month(date))
    # The calendar has 24 rows by construction: broadcasting it is bounded.
    return keyed.join(F.broadcast(cal).withColumnRenamed("month", "_m"), ["region", "_m"], "left").drop("_m")


def prev_day(df: DataFrame, key: str = "location_id", date: str = "date", cols: Sequence[str] = ()) -> DataFrame:
    """JN-17: yesterday's values by a self join on date + 1 (a gap gives no match)."""
    prev = df.select(key, F.date_add(F.col(date), 1).alias(date), *[F.col(c).alias(f"{c}_prev") for c in cols])
    return df.join(prev, [key, date], "left")


def assemble(aq: DataFrame, wx: DataFrame, pollen: DataFrame, ctx: DataFrame,
             keys: Sequence[str] = ("location_id", "date")) -> DataFrame:
    """JN-18: one nested record per (location, date) from the four domain tables.
    Weather and pollen become an error struct when the coordinates are missing."""
    k = list(keys)

    def nest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*k, F.struct(*[c for c in df.columns if c not in k]).alias(name))

    base = ctx.select(*k, "latitude", "longitude", F.struct(*[c for c in ctx.columns
                                                              if c not in k + ["latitude", "longitude"]]).alias("time_context"))
    j = base.join(nest(aq, "air_quality"), k, "left").join(nest(wx, "weather"), k, "left") \
            .join(nest(pollen, "pollen"), k, "left")
    no_coords = F.col("latitude").isNull() | F.col("longitude").isNull()
    err = F.lit("missing coordinates")

    def error_struct(name: str) -> Column:
        fields = j.schema[name].dataType.fields
        return F.struct(*[(err if f.name == "error" else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])

    return j.select(*k, "latitude", "longitude", "air_quality",
                    F.when(no_coords, error_struct("weather")).otherwise(F.col("weather")).alias("weather"),
                    F.when(no_coords, error_struct("pollen")).otherwise(F.col("pollen")).alias("pollen"),
                    "time_context")
