"""Numeric and conditional column functions (MA-01 .. MA-19).

Every function maps Columns to a Column with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airwise.functions.dates import as_col


def _ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")

# Unit factors.
MPH_TO_KMH = 1.60934
INHG_TO_PA = 3386.389
INCH_TO_MM = 25.4

# AQI -> PM2.5 breakpoints as coded (concentration low, concentration
# high, AQI high).  Up to AQI 12 the value passes through; above 500 -> 500.4.
AQI_PM_BREAKPOINTS = [
    (0.0, 12.0, 12),
    (12.1, 35.4, 50),
    (35.5, 55.4, 100),
    (55.5, 150.4, 150),
    (150.5, 250.4, 200),
    (250.5, 350.4, 300),
    (350.5, 500.4, 500),
]

# PM2.5 -> AQI breakpoints (concentration low, concentration high,
# AQI low, AQI high); negative -> 0, above 500.4 -> 500.
PM_AQI_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.0, 35.4, 50, 100),
    (35.4, 55.4, 100, 150),
    (55.4, 150.4, 150, 250),
    (150.4, 250.4, 200, 300),
    (250.4, 500.4, 300, 500),
]


def aqi_pm_segments():
    """(aqi_hi, c_lo, c_span, aqi_lo, aqi_span) per segment above the identity part."""
    out = []
    prev_hi = 0
    for c_lo, c_hi, aqi_hi in AQI_PM_BREAKPOINTS[1:]:
        out.append((aqi_hi, c_lo, c_hi - c_lo, prev_hi, aqi_hi - prev_hi))
        prev_hi = aqi_hi
    return out


def pm_aqi_segments():
    """(c_hi, aqi_lo, c_lo, factor) per segment; factor = AQI span / concentration span."""
    return [(c_hi, a_lo, c_lo, (a_hi - a_lo) / (c_hi - c_lo)) for c_lo, c_hi, a_lo, a_hi in PM_AQI_BREAKPOINTS]


def f_to_c(f) -> Column:
    """MA-01: Fahrenheit to Celsius."""
    return (as_col(f) - 32) * 5.0 / 9.0


def c_to_f_rounded(c) -> Column:
    """MA-01: Celsius to Fahrenheit, rounded half up to an integer."""
    return F.floor(as_col(c) * 9.0 / 5.0 + 32 + 0.5).cast("int")


def mph_to_kmh(v) -> Column:
    return as_col(v) * MPH_TO_KMH


def pressure_to_pa(v, uom) -> Column:
    """MA-01: pressure in Pa when the unit text names Pa, else inHg -> Pa."""
    return F.when(F.lower(as_col(uom)).contains("pa"), as_col(v)).otherwise(as_col(v) * INHG_TO_PA)


def rain_to_mm(v, uom) -> Column:
    """MA-01: rain in mm; inches when the unit is exactly in or inch (any case)."""
    return F.when(F.lower(as_col(uom)).isin("in", "inch"), as_col(v) * INCH_TO_MM).otherwise(as_col(v))


def aqi_to_pm25(aqi) -> Column:
    """MA-02: AQI to a PM2.5 estimate (identity up to 12, jump at 12)."""
    a = as_col(aqi).cast("double")
    expr = F.when(a <= 12, a)
    for hi, c_lo, c_span, a_lo, a_span in aqi_pm_segments():
        expr = expr.when(a <= hi, c_lo + (a - a_lo) * c_span / a_span)
    return expr.otherwise(F.lit(500.4))


def pm25_to_aqi(pm) -> Column:
    """MA-03: PM2.5 to AQI with the segment table (negative -> 0, above 500.4 -> 500), int truncation."""
    p = as_col(pm).cast("double")
    segs = pm_aqi_segments()
    hi0, _, _, f0 = segs[0]
    expr = F.when(p <= hi0, F.when(p >= 0, p * f0).otherwise(F.lit(0.0)))
    for hi, a_lo, c_lo, factor in segs[1:]:
        expr = expr.when(p <= hi, a_lo + (p - c_lo) * factor)
    return expr.otherwise(F.lit(500.0)).cast("int")


def proba_to_score(p) -> Column:
    """MA-04: probability -> 1..5 score, 1 dp (not monotonic at 0.5, kept)."""
    p = as_col(p)
    raw = (F.when(p < 0.2, 1 + p * 5)
           .when(p < 0.5, 2 + (p - 0.2) * 10)
           .otherwise(4 + (p - 0.5) * 2))
    return F.round(raw, 1)


def proba_to_level(p) -> Column:
    """MA-04: probability -> low / moderate / high."""
    p = as_col(p)
    return F.when(p < 0.2, "low").when(p < 0.5, "moderate").otherwise("high")


def level_label(level) -> Column:
    lv = as_col(level)
    return F.when(lv == "low", "Low").when(lv == "moderate", "Moderate").when(lv == "high", "High")


def risk_struct(p) -> Column:
    """MA-04 as the {score, level, label} struct."""
    lv = proba_to_level(p)
    return F.struct(proba_to_score(p).alias("score"), lv.alias("level"), level_label(lv).alias("label"))


def binary_score(p) -> Column:
    """MA-05: clip(1 + 4p, 1, 5), 2 dp."""
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), 1 + 4 * as_col(p))), 2)


def expected_class_score(probs, classes) -> Column:
    """MA-06: sum(p_i * class_i), 2 dp, over aligned arrays."""
    prod = F.zip_with(as_col(probs), as_col(classes), lambda p, c: p * c.cast("double"))
    return F.round(F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x), 2)


def max_probability(probs) -> Column:
    """MA-06: the largest class probability, 2 dp."""
    return F.round(F.array_max(as_col(probs)), 2)


def display_score(v) -> Column:
    """MA-07: <=0 -> 1.5, clamp to 1..5, 2 dp."""
    v = as_col(v)
    raw = F.when(v <= 0, F.lit(1.5)).otherwise(v)
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw)), 2)


def display_level(score) -> Column:
    """MA-07: <=2 low, <=4 moderate, else high."""
    s = as_col(score)
    return F.when(s <= 2, "low").when(s <= 4, "moderate").otherwise("high")


def rule_probability(aqi, pm, pollen_total) -> Column:
    """MA-08: 0.15 + capped AQI/PM/pollen terms, clamped to [0.05, 0.95]; null inputs count 0."""
    a = F.coalesce(as_col(aqi).cast("double"), F.lit(0.0))
    m = F.coalesce(as_col(pm).cast("double"), F.lit(0.0))
    po = F.coalesce(as_col(pollen_total).cast("double"), F.lit(0.0))
    raw = (F.lit(0.15) + F.least(F.lit(0.2), a / 400) + F.least(F.lit(0.15), m / 200)
           + F.least(F.lit(0.1), po / 80))
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), raw))


def date_hash_score(date_text) -> Column:
    """MA-09: sum of character codes n -> 1.5 + (n % 30)/10, clamped, 1 dp."""
    codes = F.transform(F.split(as_col(date_text), ""), lambda ch: F.ascii(ch))
    n = F.aggregate(codes, F.lit(0), lambda acc, x: acc + x)
    raw = 1.5 + F.pmod(n, F.lit(30)) / 10.0
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw)), 1)


def date_hash_level(score) -> Column:
    """MA-09 / Q12: <2 low, <4 moderate, else high."""
    s = as_col(score)
    return F.when(s < 2, "low").when(s < 4, "moderate").otherwise("high")


def bmi(height_m, weight_kg) -> Column:
    """MA-10: BMI at 1 dp, kept only for 10 < v < 80."""
    h = as_col(height_m)
    v = F.floor(as_col(weight_kg) / (h * h) * 10 + 0.5) / 10  # half up, as Math.round
    return F.when((h > 0) & (v > 10) & (v < 80), v)


def bmi_category(v) -> Column:
    v = as_col(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(v < 18.5, "Underweight").when(v < 25, "Normal")
            .when(v < 30, "Overweight").otherwise("Obese"))


def pollen_severity(v) -> Column:
    """MA-11: values above 12 are on the 0-50 scale (divide by 5)."""
    v = as_col(v)
    n = F.when(v <= 12, v).otherwise(v / 5)
    return (F.when(v.isNull() | F.isnan(v), F.lit("—"))
            .when(n <= 3, "Low").when(n <= 7, "Moderate").otherwise("High"))


def clamp_number(v, lo: float, hi: float) -> Column:
    """MA-12: non-number -> 0, then clamp to [lo, hi]."""
    x = F.coalesce(as_col(v).try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def pollen_total(tree, grass, weed) -> Column:
    """MA-13: pollen total with nulls counted as 0."""
    return (F.coalesce(as_col(tree), F.lit(0.0)) + F.coalesce(as_col(grass), F.lit(0.0))
            + F.coalesce(as_col(weed), F.lit(0.0)))


def aqi_trend(today_max, yesterday_mean) -> Column:
    """MA-15: 24 h trend from today's max and yesterday's mean AQI."""
    t, y = as_col(today_max), as_col(yesterday_mean)
    return (F.when(t.isNull() | y.isNull(), F.lit(None).cast("string"))
            .when(t > y, "up").when(t < y, "down").otherwise("stable"))


def pollen_region(lat, lon) -> Column:
    """MA-16: 'US_South' below 37 N inside the US box, 'US' above, else null."""
    la, lo = as_col(lat), as_col(lon)
    in_us = la.between(24.0, 50.0) & lo.between(-125.0, -66.0)
    return F.when(in_us & (la < 37.0), "US_South").when(in_us, "US")


# Pollen level word -> index.
POLLEN_LEVELS = [("none", 0), ("low", 1), ("medium", 2), ("heavy", 3), ("extremely heavy", 4)]


def level_index(word) -> Column:
    """MA-17: level word -> index; unknown -> null."""
    m = F.create_map(*[x for k, v in POLLEN_LEVELS for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.lower(_ws_trim(as_col(word))))


def category_index(value, names: list[str]) -> Column:
    """MA-18: category text (any case) or number (modulo) -> 0-based index; unknown -> 0."""
    v = as_col(value).cast("string")
    lowered = F.array(*[F.lit(n.lower()) for n in names])
    pos = F.array_position(lowered, F.lower(_ws_trim(v))) - 1
    num = v.try_cast("int")
    return (F.when(num.isNotNull(), F.pmod(num, F.lit(len(names))))
            .when(pos >= 0, pos.cast("int"))
            .otherwise(F.lit(0)))


def category_name(idx, names: list[str]) -> Column:
    """MA-18 / PRJ-13: index modulo len(names) -> name."""
    arr = F.array(*[F.lit(n) for n in names])
    return F.element_at(arr, (F.pmod(as_col(idx).cast("int"), F.lit(len(names))) + 1).cast("int"))


def clip_score(v, lo: float = 1.0, hi: float = 5.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), as_col(v)))
