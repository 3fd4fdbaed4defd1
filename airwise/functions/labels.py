"""Label rules (LB-01 .. LB-07) as column expressions and small DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.functions.dates import as_col
from airwise.operators import windows as W

# Default label thresholds (parameters of the rules).
AQI_HIGH = 101.0
PM25_HIGH = 35.0
POLLEN_HIGH = 8.0


def _true(c: Column) -> Column:
    """Null comparison counts as false (pandas semantics)."""
    return F.coalesce(c, F.lit(False))


def high_risk_tomorrow(df: DataFrame, key: str = "location_id", aqi_high: float = AQI_HIGH,
                       pm_high: float = PM25_HIGH, pollen_high: float = POLLEN_HIGH) -> DataFrame:
    """LB-01 (+ WN-09, FLT-11): label from tomorrow's AQI / PM / pollen; last row per series dropped."""
    w = W.series(key)
    out = (df.withColumn("AQI_tomorrow", W.lead("AQI", w))
             .withColumn("PM2_5_mean_tomorrow", W.lead("PM2_5_mean", w))
             .withColumn("pollen_total_tomorrow", W.lead("pollen_total", w)))
    out = out.where(F.col("AQI_tomorrow").isNotNull() & F.col("PM2_5_mean_tomorrow").isNotNull()
                    & F.col("pollen_total_tomorrow").isNotNull())
    y = ((F.col("AQI_tomorrow") >= aqi_high) | (F.col("PM2_5_mean_tomorrow") >= pm_high)
         | (F.col("pollen_total_tomorrow") >= pollen_high))
    return out.withColumn("y", y.cast("int"))


def personal_risk(symptom, aqi, pm, pollen_sum) -> Column:
    """LB-02: risk = symptom>=4 or AQI>100 or PM>35 or pollen sum>20 (null -> false)."""
    c = (_true(as_col(symptom) >= 4) | _true(as_col(aqi) > 100) | _true(as_col(pm) > 35)
         | _true(as_col(pollen_sum) > 20))
    return c.cast("int")


def flare_day(symptom) -> Column:
    """LB-02: flare_day = symptom >= 6."""
    return _true(as_col(symptom) >= 6).cast("int")


def severe(symptom_score) -> Column:
    """LB-03: severe = symptomScore >= 4."""
    return _true(as_col(symptom_score) >= 4).cast("int")


def seed_rule(aqi, pm) -> Column:
    """LB-04: AQI > 50 or PM > 15."""
    return (_true(as_col(aqi) > 50) | _true(as_col(pm) > 15)).cast("int")


def seeded_coin(key, seed: int = 42) -> Column:
    """LB-04 random variant: deterministic 0/1, the parity of the first hex digit of MD5(seed:key)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")))
    return (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 2).cast("int")


def demo_next_day(df: DataFrame, key: str = "location_id", seed: int = 7) -> DataFrame:
    """LB-05: label = tomorrow AQI > 50 or PM > 15; last day 0.  When only one
    class occurs, exactly half of the rows (n // 2, one at least) are flipped: the
    first ones in the order of MD5(seed:key:date), so both classes exist."""
    w = W.series(key)
    nxt = _true(W.lead("AQI", w) > 50) | _true(W.lead("PM2_5_mean", w) > 15)
    out = df.withColumn("flare", nxt.cast("int"))
    # Scalar subqueries: each is one aggregate row inlined into the plan.
    lo = out.agg(F.min("flare")).scalar()
    hi = out.agg(F.max("flare")).scalar()
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("date").cast("string")))
    ranked = W.row_index(out.withColumn("_h", h), [F.col("_h"), F.col(key), F.col("date")])
    flip = F.col("row_idx") < F.greatest(F.lit(1), F.floor(F.col("n_rows") / 2))
    return ranked.withColumn("flare", F.when((lo == hi) & flip, 1 - F.col("flare")).otherwise(F.col("flare"))).select(*out.columns)


def flare_by_threshold(value, threshold) -> Column:
    """LB-06: flare day when value >= threshold (threshold may be a quantile column)."""
    return _true(as_col(value) >= as_col(threshold)).cast("int")


def flare_and_bins(df: DataFrame, c: str, flare: str = "flare_day", risk: str = "risk", q: float = 0.8,
                   qs=(0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """LB-06 and LB-07 on one column: threshold and bin edges from one pass over its values."""
    from airwise.operators.quantiles import quantiles_array
    points = quantiles_array(df, c, [q, *qs])
    x = F.col(c)
    at = lambda i: F.col("_points").getItem(i)
    n_below = sum(F.coalesce((at(i + 1) < x).cast("int"), F.lit(0)) for i in range(len(qs)))
    return df.withColumn("_points", points).withColumn(flare, flare_by_threshold(x, at(0))) \
        .withColumn(risk, F.when(x.isNotNull(), (n_below + 1).cast("int"))).drop("_points")


def quantile_bins(df: DataFrame, c: str, out: str = "risk", qs=(0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """LB-07: 1..5 by right-closed bins on interpolated quantile edges:
    bin = 1 + number of edges strictly below the value (null stays null).
    Equal edges are allowed (Q21)."""
    from airwise.operators.quantiles import quantiles_array
    edges = quantiles_array(df, c, list(qs))  # one scalar subquery for all edges
    x = F.col(c)
    n_below = sum(F.coalesce((F.col("_edges").getItem(i) < x).cast("int"), F.lit(0)) for i in range(len(qs)))
    return df.withColumn("_edges", edges).withColumn(out, F.when(x.isNotNull(), (n_below + 1).cast("int"))).drop("_edges")
