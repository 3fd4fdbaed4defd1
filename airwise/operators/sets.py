"""Set operations and generators (ST-01 .. ST-06).

Generators never cross-join two tables: each key row expands its own date
range with ``explode(sequence(...))``, so the output is produced where the
key row already lives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airwise.functions import dates as D
from airwise.functions.dates import as_col


def missing_pairs(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ST-01: key pairs in ``wanted`` and not in ``have`` (left anti join)."""
    return wanted.select(*keys).join(have.select(*keys), list(keys), "left_anti")


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ST-02: distinct users / dates."""
    return df.select(*cols).distinct()


def first_available(sources: Sequence[DataFrame], keys: Sequence[str], valid: Sequence[Column] | None = None,
                    fallback_last: bool = False) -> DataFrame:
    """ST-03: per key, the row of the highest-priority source that is valid.

    ``sources`` are in priority order with the same columns; ``valid[i]``
    tells whether a row of source i may be used.  With ``fallback_last`` the
    first source's row is kept when no source is valid (air-quality rule:
    keep the first result when the second also errors)."""
    parts = []
    for i, s in enumerate(sources):
        ok = valid[i] if valid is not None else F.lit(True)
        parts.append(s.select("*", F.lit(i).alias("_prio"), F.coalesce(ok, F.lit(False)).alias("_ok")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    if not fallback_last:
        u = u.where("_ok")
    # valid rows first, then priority; one row per key.
    w = Window.partitionBy(*keys).orderBy(F.col("_ok").desc(), F.col("_prio"))
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_ok") \
            .withColumnRenamed("_prio", "source_rank")


def date_spine(spark: SparkSession, start, end) -> DataFrame:
    """ST-05: inclusive one-row-per-day spine."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                             F.expr("INTERVAL 1 DAY"))).alias("date"))


def expand_dates(keys: DataFrame, start: Column, end: Column, batch_days: int | None = None) -> DataFrame:
    """ST-05/ST-06: every key row times every day of [start, end] (per-row explode,
    no join); optional batch id floor(i / batch_days)."""
    out = keys.select("*", F.posexplode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("day_idx", "date"))
    if batch_days:
        out = out.withColumn("batch", F.floor(F.col("day_idx") / batch_days).cast("int"))
    return out


def synthetic_env(rows: DataFrame, variant: str = "risk") -> DataFrame:
    """ST-04: deterministic env measures from j = (ordinal(date) % 7) / 7.

    variant 'risk' (int AQI, season 1..4, pressure 1013), 'flare' (season
    0..3) or 'forecast' (float AQI, names for weekday/season)."""
    d = F.col("date")
    j = F.pmod(D.iso_ordinal(d), F.lit(7)) / 7.0
    pm = 10.0 + 8 * j
    common = [
        (F.lit(40.0) + 30 * j if variant == "forecast" else (40 + F.floor(30 * j)).cast("double")).alias("AQI"),
        (pm * 1.4).alias("PM2_5_max"), pm.alias("PM2_5_mean"),
        (22.0 + 5 * j).alias("temp_max"), (10.0 + 3 * j).alias("temp_min"),
        (55.0 + 20 * j).alias("humidity"), (5.0 + 5 * j).alias("wind"),
        F.lit(0.0).alias("rain"), F.lit(1013.0).alias("pressure"),
    ]
    if variant == "forecast":
        cal = [D.weekday_name(d).alias("day_of_week"), F.month(d).alias("month"),
               D.season_name(F.month(d)).alias("season"), F.lit(False).alias("holiday_flag")]
        pollen = []
    else:
        cal = [D.weekday_num(d).alias("day_of_week"), F.month(d).alias("month"),
               D.season_num(F.month(d), zero_based=(variant == "flare")).alias("season"),
               F.lit(0).alias("holiday_flag")]
        pollen = [(2.0 + 2 * j).alias("pollen_tree"), (1.0 + j).alias("pollen_grass"), (0.5 + j).alias("pollen_weed")]
    return rows.select("*", *common, *pollen, *cal)


# ---------------------------------------------------------------- ST-03 source rules

def air_priority(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], prefer_secondary: bool = False,
                 has_coords: Column | None = None) -> DataFrame:
    """ST-03 (air quality): the preferred source unless it reports an error.

    Default order primary -> secondary: move on only when the primary errors and the
    location has coordinates, and keep the primary if the secondary errors too.
    ``prefer_secondary`` (with coordinates): secondary first, primary whenever the
    secondary errors.  Sources share the value columns and an ``error`` column."""
    keys = list(keys)
    vals = [c for c in primary.columns if c not in keys]
    p = primary.select(*keys, F.struct(*vals).alias("_a"))
    s = secondary.select(*keys, F.struct(*vals).alias("_b"))
    j = p.join(s, keys, "full")
    coords = has_coords if has_coords is not None else F.lit(True)
    a_err = F.col("_a").isNull() | F.col("_a.error").isNotNull()
    b_err = F.col("_b").isNull() | F.col("_b.error").isNotNull()
    pick_b = (coords & ~b_err) if prefer_secondary else (a_err & coords & ~b_err)
    src = F.when(pick_b, F.lit("secondary")).otherwise(F.lit("primary"))
    return j.select(*keys, *[F.when(pick_b, F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}")).alias(c) for c in vals],
                    src.alias("source"))


def pollen_priority(forecast: DataFrame, station: DataFrame, calendar: DataFrame, keys: Sequence[str],
                    region: Column) -> DataFrame:
    """ST-03 (pollen): the forecast unless all three indices are null without an error;
    then, in the southern region, the station report if it has any index, else the
    regional calendar; outside the known regions the (empty) forecast stays."""
    keys = list(keys)
    idx = ["tree_index", "grass_index", "weed_index"]
    f = forecast.select(*keys, region.alias("_region"), *idx, "error")
    st_ = station.select(*keys, F.struct(*idx).alias("_s"))
    ca = calendar.select(*keys, F.struct(*idx).alias("_c"))
    j = f.join(st_, keys, "left").join(ca, keys, "left")
    empty = F.col("tree_index").isNull() & F.col("grass_index").isNull() & F.col("weed_index").isNull() \
        & F.col("error").isNull()
    station_ok = F.col("_s").isNotNull() & (F.col("_s.tree_index").isNotNull() | F.col("_s.grass_index").isNotNull()
                                            | F.col("_s.weed_index").isNotNull())
    use_station = empty & (F.col("_region") == "US_South") & station_ok
    use_calendar = empty & F.col("_region").isNotNull() & ~use_station
    src = F.when(use_station, "station").when(use_calendar, "calendar").otherwise("forecast")
    return j.select(*keys, *[F.when(use_station, F.col(f"_s.{c}")).when(use_calendar, F.col(f"_c.{c}"))
                             .otherwise(F.col(c)).alias(c) for c in idx],
                    F.when(use_station | use_calendar, F.lit(None).cast("string")).otherwise(F.col("error")).alias("error"),
                    src.alias("source"))


def env_source_priority(store: DataFrame, forecast: DataFrame, generated: DataFrame, key: str, n_days: int) -> DataFrame:
    """ST-03 (environment): per location, the stored rows when the store holds at least
    min(2, n_days + 1) rows of the window; else the forecast rows when there are any;
    else the generated rows.  Decided per location with one count per source."""
    need = min(2, n_days + 1)
    s_cnt = store.groupBy(key).agg(F.count(F.lit(1)).alias("_ns"))
    f_cnt = forecast.groupBy(key).agg(F.count(F.lit(1)).alias("_nf"))
    locs = generated.select(key).distinct().join(s_cnt, key, "left").join(f_cnt, key, "left")
    choice = locs.select(key, F.when(F.coalesce(F.col("_ns"), F.lit(0)) >= need, "store")
                         .when(F.coalesce(F.col("_nf"), F.lit(0)) > 0, "forecast").otherwise("generated").alias("source"))
    cols = [c for c in generated.columns]
    parts = [store.select(*cols).withColumn("source", F.lit("store")),
             forecast.select(*cols).withColumn("source", F.lit("forecast")),
             generated.select(*cols).withColumn("source", F.lit("generated"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.join(choice, [key, "source"], "left_semi")
