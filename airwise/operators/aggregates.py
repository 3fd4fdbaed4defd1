"""Aggregations (AG-01 .. AG-24).

All rollups are hash aggregates with a map-side partial step, so a hot key
(a location with a third of all readings) contributes one partial row per
task to the shuffle.  Exact quantiles come from ``operators.quantiles`` (distributed,
linear interpolation), moments from ``avg`` / ``stddev_samp``; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.functions.dates import as_col
from airwise.operators.quantiles import quantiles_array
from airwise.operators.quantiles import quantile as exact_quantile


def daily_weather(hourly: DataFrame, key: str = "location_id", ts: str = "ts", temp: str = "temp",
                  humidity: str = "humidity", wind: str = "wind", pressure: str = "pressure",
                  rain: str = "rain") -> DataFrame:
    """AG-01: hourly weather -> daily min/max temp, mean humidity/wind/pressure, rain sum (all-null sum = 0)."""
    return hourly.groupBy(key, F.to_date(ts).alias("date")).agg(
        F.min(temp).alias("temp_min"), F.max(temp).alias("temp_max"),
        F.avg(humidity).alias("humidity"), F.avg(wind).alias("wind"), F.avg(pressure).alias("pressure"),
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("rain"))


def daily_pm(hourly: DataFrame, key: str = "location_id", ts: str = "ts", pm: str = "pm") -> DataFrame:
    """AG-02: hourly PM2.5 -> daily mean and max."""
    return hourly.groupBy(key, F.to_date(ts).alias("date")).agg(
        F.avg(pm).alias("PM2_5_mean"), F.max(pm).alias("PM2_5_max"))


def chunk_means(arr, n_days: int) -> Column:
    """AG-03: split an hourly array into n_days positional chunks of len // n_days
    and take the null-skipping mean of each (null when a chunk has no value)."""
    a = as_col(arr)
    size = F.floor(F.size(a) / n_days).cast("int")

    def mean_of(i):
        chunk = F.filter(F.slice(a, i * size + 1, size), lambda x: x.isNotNull())
        total = F.aggregate(chunk, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return F.when(F.size(chunk) > 0, total / F.size(chunk))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n_days - 1)), mean_of))


TREE = ["alder_pollen", "birch_pollen", "olive_pollen"]
WEED = ["mugwort_pollen", "ragweed_pollen"]
GRASS = ["grass_pollen"]


def daily_pollen(hourly: DataFrame, key: str = "location_id", ts: str = "time") -> DataFrame:
    """AG-04: per hour the max of each species group (greatest skips nulls), per day the max."""
    return hourly.groupBy(key, F.to_date(ts).alias("date")).agg(
        F.max(F.greatest(*[F.col(c) for c in TREE])).alias("pollen_tree"),
        F.max(F.greatest(*[F.col(c) for c in GRASS] + [F.lit(None).cast("double")])).alias("pollen_grass"),
        F.max(F.greatest(*[F.col(c) for c in WEED])).alias("pollen_weed"))


def daily_sensors(rows: DataFrame, key: str = "location_id", date: str = "date") -> DataFrame:
    """AG-07: mean / max of 24 h values, falling back to the 60 min values."""
    return rows.groupBy(key, date).agg(
        F.coalesce(F.avg("pm_24h"), F.avg("pm_60m")).alias("pm25_mean"),
        F.coalesce(F.max("pm_24h"), F.max("pm_60m")).alias("pm25_max"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """AG-08: counts per value."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("count"))


def describe_col(df: DataFrame, c: str) -> DataFrame:
    """AG-09: count, mean, std (n-1), min, quartiles (linear interpolation), max."""
    x = F.col(c).cast("double")
    q = quantiles_array(df, c, [0.25, 0.5, 0.75])
    return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max")).withColumn("_q", q) \
        .select("count", "mean", "std", "min", F.col("_q").getItem(0).alias("q25"), F.col("_q").getItem(1).alias("q50"), F.col("_q").getItem(2).alias("q75"), "max")


def null_counts(df: DataFrame) -> DataFrame:
    """AG-10: (column, nulls) for columns with at least one null, one aggregate pass."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "nulls")
    return long.where(F.col("nulls") > 0)


def correlations(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """AG-11: Pearson r of each column with the target (pairwise complete), by |r| desc."""
    others = [c for c in cols if c != target]
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in others])
    long = wide.unpivot([], others, "column", "r")
    return long.orderBy(F.abs("r").desc_nulls_last(), "column")


def total_checkins(users: DataFrame, arr: str = "checkIns") -> DataFrame:
    """AG-13: total nested elements (null array = 0)."""
    return users.agg(F.sum(F.size(F.coalesce(F.col(arr), F.array()))).cast("long").alias("total_checkins"))


def date_range(df: DataFrame, col: str = "date") -> DataFrame:
    """AG-14: min / max date."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def n_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG-15: exact distinct counts per column."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in cols])


def quantile(df: DataFrame, c: str, q: float) -> Column:
    """AG-16: exact interpolated quantile as a scalar-subquery column (distributed)."""
    return exact_quantile(df, c, q)


def users_without_symptoms(df: DataFrame, key: str = "user_id",
                           cols: Sequence[str] = ("wheeze", "cough", "chestTightness")) -> DataFrame:
    """AG-17: per user, true when every symptom value is zero."""
    allzero = F.lit(True)
    for c in cols:
        allzero = allzero & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return df.groupBy(key).agg(F.bool_and(allzero).alias("no_symptoms"))


def positive_rate(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """AG-18: mean of the 0/1 label."""
    return df.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("positive_rate"))


def week_summary(df: DataFrame, probs: str = "probs", by: Sequence[str] = ()) -> DataFrame:
    """AG-19: mean / min / max of the argmax class over the rows."""
    a = F.col(probs)
    cls = (F.array_position(a, F.array_max(a)) - 1).cast("int")
    return df.groupBy(*by).agg(F.avg(cls).alias("mean_level"), F.min(cls).alias("min_level"),
                               F.max(cls).alias("max_level"))


def score_summary(df: DataFrame, score: str, lo: float = 1.0, hi: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """AG-20: min / max / mean after clipping to [lo, hi]."""
    s = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(score)))
    return df.groupBy(*by).agg(F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.avg(s).alias("score_mean"))


def fold_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """AG-21: mean and population std of per-fold metrics."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.agg(*aggs)


def split_counts(df: DataFrame, split: str = "split", y: str | None = None) -> DataFrame:
    """AG-22: rows per split, or per (split, class)."""
    keys = [split] + ([y] if y else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def alert_summary(df: DataFrame, sent: str = "sent") -> DataFrame:
    """AG-23: users checked, sent, skipped."""
    return df.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col(sent)).alias("sent"),
                  F.count_if(~F.col(sent)).alias("skipped"))


def week_digest(df: DataFrame, key: str, line: Column, date: str = "date") -> DataFrame:
    """AG-24: per key, the day lines ordered by date joined with newlines.

    Callers filter to the forecast window first, so each group holds at most
    that many rows (7 by default) before ``collect_list``."""
    return df.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("digest"))
