"""Landed payload parsers (SRC-06 .. SRC-10) and their daily rollups (AG-05, AG-06).

Payloads arrive as text columns (one forecast / observation / sensor batch /
report page per row).  Each row is parsed with ``from_json`` or regular
expressions and exploded in place; the daily rollups are ordinary grouped
aggregates.  A row's payload is bounded by its own size, so no step
gathers many rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.functions.strings import ws_trim

from airwise.functions import dates as D
from airwise.functions import mathx as M


def round_dp(c: Column, n: int) -> Column:
    """Python-style round(x, n): Spark's HALF_UP on the double's shortest decimal text,
    which agrees with Python's round except at exact binary ties."""
    return F.round(c, n)

def mean_exact(c: Column) -> Column:
    """Aggregate: mean over the values taken as decimals (exact sum, then one division),
    so a rounded daily mean does not depend on the order partial sums are combined in."""
    return F.sum(c.cast("decimal(24,6)")) / F.count(c)


# ------------------------------------------------------------------ SRC-06

def explode_parallel_arrays(df: DataFrame, payload: str, struct_field: str, fields: Sequence[str],
                            keep: Sequence[str] = (), time_field: str = "time") -> DataFrame:
    """SRC-06: ``{struct_field: {time: [...], f1: [...], ...}}`` -> one row per time slot.
    Arrays of unequal length are padded with nulls (``arrays_zip``)."""
    schema = f"struct<{struct_field}:struct<{time_field}:array<string>," + \
             ",".join(f"{f}:array<double>" for f in fields) + ">>"
    parsed = df.select(*keep, F.from_json(F.col(payload), schema)[struct_field].alias("_h"))
    zipped = parsed.select(*keep, F.posexplode(F.arrays_zip(*[F.col(f"_h.{c}").alias(c) for c in [time_field, *fields]]))
                           .alias("slot", "_z"))
    return zipped.select(*keep, "slot", F.to_timestamp_ntz(F.col(f"_z.{time_field}")).alias("time"),
                         *[F.col(f"_z.{c}").alias(c) for c in fields])


# ------------------------------------------------------------------ SRC-07 / AG-06

GRID_VARIABLES = ["minTemperature", "maxTemperature", "temperature", "relativeHumidity", "windSpeed", "pressure",
                  "quantitativePrecipitation"]


def explode_intervals(df: DataFrame, payload: str, keep: Sequence[str] = (),
                      variables: Sequence[str] = GRID_VARIABLES) -> DataFrame:
    """SRC-07: grid forecast -> (variable, uom, valid_time, date, value); values that
    are not numbers are dropped; the date is the interval start in its own offset.

    ``properties`` is parsed as a map (variable -> series) and exploded once, which
    is cheaper than a struct with one field per variable followed by an array of them."""
    series = "struct<uom:string,values:array<struct<validTime:string,value:string>>>"
    schema = f"struct<properties:map<string,{series}>>"
    per_var = df.select(*keep, F.explode(F.from_json(F.col(payload), schema)["properties"]).alias("variable", "_s")) \
        .where(F.col("variable").isin(list(variables)))
    rows = per_var.select(*keep, "variable", F.col("_s.uom").alias("uom"), F.explode("_s.values").alias("_v"))
    vt = F.col("_v.validTime")
    out = rows.select(*keep, "variable", "uom", vt.alias("valid_time"),
                      F.when(F.instr(vt, "/") > 0, D.interval_start_date(vt)).alias("date"),
                      F.col("_v.value").try_cast("double").alias("value"))
    return out.where(F.col("value").isNotNull() & F.col("date").isNotNull())


def daily_grid(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-06: grid intervals -> daily weather.  Temperatures are degF, wind mph; min/max
    series are used unless both are absent for the day, then the temperature series;
    pressure in Pa when the unit names Pa else inHg; rain summed, inches -> mm; 2 dp."""
    v = F.col("variable")

    def vals(name):
        return F.when(v == name, F.col("value"))

    g = intervals.groupBy(*keys, "date").agg(
        F.min(vals("minTemperature")).alias("_mn"), F.max(vals("maxTemperature")).alias("_mx"),
        F.min(vals("temperature")).alias("_tmn"), F.max(vals("temperature")).alias("_tmx"),
        mean_exact(vals("relativeHumidity")).alias("_hm"), F.max(vals("relativeHumidity")).alias("_hx"),
        mean_exact(vals("windSpeed")).cast("double").alias("_w"),
        mean_exact(vals("pressure")).alias("_p"), F.max(F.when(v == "pressure", F.col("uom"))).alias("_pu"),
        F.sum(vals("quantitativePrecipitation")).alias("_r"),
        F.max(F.when(v == "quantitativePrecipitation", F.col("uom"))).alias("_ru"))
    no_minmax = F.col("_mn").isNull() & F.col("_mx").isNull()
    tmin = F.when(no_minmax, F.col("_tmn")).otherwise(F.col("_mn"))
    tmax = F.when(no_minmax, F.col("_tmx")).otherwise(F.col("_mx"))
    pa = F.when(F.lower(F.coalesce(F.col("_pu"), F.lit(""))).contains("pa"), F.col("_p")) \
        .otherwise(F.col("_p").cast("double") * M.INHG_TO_PA)
    rain = F.when(F.lower(F.coalesce(F.col("_ru"), F.lit(""))).isin("in", "inch"), F.col("_r") * M.INCH_TO_MM) \
        .otherwise(F.col("_r"))
    return g.select(*keys, "date", round_dp(M.f_to_c(tmin), 2).alias("temp_min_c"),
                    round_dp(M.f_to_c(tmax), 2).alias("temp_max_c"),
                    round_dp(F.col("_hm"), 2).cast("double").alias("humidity_mean"),
                    round_dp(F.col("_hx"), 2).alias("humidity_max"),
                    round_dp(M.mph_to_kmh(F.col("_w")), 2).alias("wind_speed_kmh"),
                    round_dp(pa, 2).cast("double").alias("pressure_pa"), round_dp(rain, 2).alias("rain_mm"))


# ------------------------------------------------------------------ SRC-08 / AG-05

OBS_SCHEMA = ("array<struct<ParameterName:string,AQI:double,RawConcentration:string,"
              "Category:struct<Name:string>,CategoryName:string,DateObserved:string>>")


def parse_observations(df: DataFrame, payload: str, keep: Sequence[str] = (), exact_mode: bool = False) -> DataFrame:
    """SRC-08: observation payload (an array, or one object -> one element) -> rows.
    Category comes from Category.Name or CategoryName.  Missing concentration stays
    null (Q8 fix); ``exact_mode`` reproduces the as-coded 0.0."""
    obs = df.select(*keep, F.explode(F.from_json(F.col(payload), OBS_SCHEMA)).alias("_o"))
    conc = F.col("_o.RawConcentration").try_cast("double")
    is_pm = F.col("_o.ParameterName") == "PM2.5"
    if exact_mode:
        conc = F.coalesce(conc, F.lit(0.0))
    return obs.select(*keep, F.col("_o.ParameterName").alias("ParameterName"), F.col("_o.AQI").alias("AQI"),
                      F.when(is_pm, conc).alias("concentration"),
                      F.coalesce(F.col("_o.Category.Name"), F.col("_o.CategoryName")).alias("category"),
                      F.col("_o.DateObserved").alias("DateObserved"))


def daily_sensors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-07 + MA-03 on parsed sensor rows: mean/max of the 24 h values, else the 60 min
    values (2 dp); AQI from the mean, truncated."""
    g = rows.groupBy(*keys).agg(F.coalesce(mean_exact(F.col("pm_24h")), mean_exact(F.col("pm_60m"))).alias("_m"),
                                F.coalesce(F.max("pm_24h"), F.max("pm_60m")).alias("_x"))
    return g.select(*keys, round_dp(F.col("_m"), 2).cast("double").alias("pm25_mean"),
                    round_dp(F.col("_x"), 2).alias("pm25_max"), M.pm25_to_aqi(F.col("_m").cast("double")).alias("aqi"))


def daily_observations(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-05: PM2.5 mean / max of the concentrations (2 dp), max AQI as int; when a PM2.5
    row has no concentration its AQI is converted back to PM (MA-02)."""
    is_pm = F.col("ParameterName") == "PM2.5"
    pm = F.when(is_pm, F.coalesce(F.col("concentration"), M.aqi_to_pm25(F.col("AQI"))))
    return obs.groupBy(*keys).agg(mean_exact(pm).alias("_m"), F.max(pm).alias("_x"), F.max("AQI").alias("_a")) \
        .select(*keys, round_dp(F.col("_m"), 2).cast("double").alias("pm25_mean"), round_dp(F.col("_x"), 2).alias("pm25_max"),
                F.col("_a").cast("int").alias("aqi"))


# ------------------------------------------------------------------ SRC-09

def parse_sensor_rows(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """SRC-09: ``{"data": [[...], ...]}`` positional rows; the last two fields are the
    60-minute and 24-hour PM2.5; rows with fewer than two fields are skipped."""
    rows = df.select(*keep, F.explode(F.from_json(F.col(payload), "struct<data:array<array<double>>>")["data"]).alias("_r"))
    return rows.where(F.size("_r") >= 2).select(*keep, F.element_at("_r", -2).alias("pm_60m"),
                                                F.element_at("_r", -1).alias("pm_24h"))


# ------------------------------------------------------------------ SRC-10

# Pollen level words of the report page and their index.
LEVEL_WORDS = r"(HEAVY|LOW|MEDIUM|NONE|Extremely\s*Heavy)"
LEVEL_INDEX = [("none", 0), ("low", 1), ("medium", 2), ("heavy", 3), ("extremely heavy", 4), ("extremelyheavy", 4)]


def extract_levels(df: DataFrame, html: str, keep: Sequence[str] = (), link_marker: str = "pollen-mold-count-",
                   kinds: Sequence[tuple[str, str]] = (("TREE", "tree_index"), ("GRASS", "grass_index"),
                                                       ("WEED", "weed_index"))) -> DataFrame:
    """SRC-10: first report link, then the level word after '<KIND> POLLEN' mapped to an
    index (case-insensitive); a page with no level at all gives no row."""
    h = F.col(html)
    link = F.regexp_extract(h, r"(?i)href=[\"']([^\"']*" + link_marker + r"[^\"']+)[\"']", 1)
    m = F.create_map(*[x for k, v in LEVEL_INDEX for x in (F.lit(k), F.lit(v))])
    cols = []
    for kind, name in kinds:
        word = F.regexp_extract(h, r"(?i)" + kind + r"\s*POLLEN\s*" + LEVEL_WORDS + r"\s*[\d,]*", 1)
        cols.append(F.element_at(m, F.regexp_replace(F.lower(ws_trim(word)), " ", "")).alias(name))
    out = df.select(*keep, F.nullif(link, F.lit("")).alias("report_link"), *cols)
    names = [n for _, n in kinds]
    return out.where(F.greatest(*[F.col(n).isNotNull() for n in names]))
