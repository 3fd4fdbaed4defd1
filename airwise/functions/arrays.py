"""Array / struct / map / JSON column functions (AJ-01 .. AJ-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.functions.dates import as_col

# Risk factor rules (id, label, icon key) and thresholds.
FACTOR_AIR = ("air", "Poor Air Quality", "wind")
FACTOR_PM = ("pm25", "High PM2.5", "wind")
FACTOR_POLLEN = ("pollen", "High Pollen", "sprout")
FACTOR_TEMP = ("temp", "Cold Temperature", "thermometer")
FACTOR_HUMIDITY = ("humidity", "High Humidity", "droplets")
FACTOR_GENERAL = ("general", "Environmental conditions", "wind")

# Icon key -> icon name lookup.
ICONS = [("wind", "Wind"), ("sprout", "Sprout"), ("thermometer", "Thermometer"), ("droplets", "Droplets")]


def _factor(t) -> Column:
    return F.struct(F.lit(t[0]).alias("id"), F.lit(t[1]).alias("label"), F.lit(t[2]).alias("iconKey"))


def risk_factors(aqi, pm, pollen_total, temp_min=None, humidity=None, aqi_high: float = 101.0,
                 pm_high: float = 35.0, pollen_high: float = 8.0) -> Column:
    """AJ-01: active factors; five rules when temp/humidity given, else three; 'general' when none."""
    rules = [(as_col(aqi) >= aqi_high, FACTOR_AIR), (as_col(pm) >= pm_high, FACTOR_PM),
             (as_col(pollen_total) >= pollen_high, FACTOR_POLLEN)]
    if temp_min is not None:
        rules.append((as_col(temp_min) < 5, FACTOR_TEMP))
    if humidity is not None:
        rules.append((as_col(humidity) >= 80, FACTOR_HUMIDITY))
    arr = F.filter(F.array(*[F.when(cond, _factor(t)) for cond, t in rules]), lambda x: x.isNotNull())
    return F.when(F.size(arr) == 0, F.array(_factor(FACTOR_GENERAL))).otherwise(arr)


def factor_ids(factors) -> Column:
    """Flatten an AJ-01 array to 'id,id,..' text."""
    return F.array_join(F.transform(as_col(factors), lambda x: x["id"]), ",")


def explode_checkins(users: DataFrame, key: str = "user_id", arr: str = "checkIns") -> DataFrame:
    """AJ-02: one row per nested check-in; users without check-ins give no rows."""
    return users.select(key, F.explode(arr).alias("_c")).select(key, "_c.*")


REC_SCHEMA = "array<struct<id:string,title:string,description:string>>"
REC_WRAPPER_SCHEMA = ("struct<recommendations:array<struct<id:string,title:string,description:string>>,"
                      "items:array<struct<id:string,title:string,description:string>>,"
                      "recs:array<struct<id:string,title:string,description:string>>>")
FENCE_RE = r"```(?:json)?\s*([\s\S]*?)```"

# The default recommendation list used when a reply yields nothing.
DEFAULT_RECOMMENDATIONS = [
    ("limit-outdoor", "Limit Outdoor Activities",
     "Pollen levels are high today. Consider staying indoors during peak hours."),
    ("inhaler", "Keep Rescue Inhaler Nearby",
     "Your risk is elevated. Make sure your quick-relief inhaler is accessible."),
    ("monitor", "Monitor Symptoms Closely",
     "Track any wheezing, coughing, or chest tightness throughout the day."),
    ("air-quality", "Check Air Quality Before Exercise",
     "Air quality is poor. Choose early morning or evening for outdoor activities."),
    ("windows", "Close Windows Today",
     "Keep windows closed to prevent outdoor allergens from entering your home."),
]


def parse_recommendations(text, with_default: bool = True) -> Column:
    """AJ-03 (+STR-10): recommendation list out of model text.

    The first code fence's content is used when there is one; parsing starts at the
    first '[' (the whole rest must be the JSON array), else an object with
    recommendations / items / recs.  Items need a non-blank title and description;
    ids become slugs, 'rec-<i>' (i = position in the reply) when empty.  When nothing
    is left the default list is returned (``with_default``)."""
    from airwise.functions.strings import slug

    def ws_trim(c):  # trims every kind of whitespace, not only spaces
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    raw = ws_trim(F.coalesce(as_col(text), F.lit("")))
    raw = F.when(raw.rlike(FENCE_RE), ws_trim(F.regexp_extract(raw, FENCE_RE, 1))).otherwise(raw)
    start = F.instr(raw, "[")
    tail = ws_trim(F.substring(raw, start, F.lit(1 << 30)))
    as_list = F.when(tail.endswith("]"), F.from_json(tail, REC_SCHEMA))
    obj = F.from_json(raw, REC_WRAPPER_SCHEMA)
    chosen = F.when(start > 0, as_list).when(raw.startswith("{"),
                                             F.coalesce(obj["recommendations"], obj["items"], obj["recs"]))
    arr = F.coalesce(chosen, F.array().cast(REC_SCHEMA))
    shaped = F.transform(arr, lambda x, i: F.struct(
        slug(F.coalesce(x["id"], F.lit("")), i).alias("id"),
        ws_trim(F.coalesce(x["title"], F.lit(""))).alias("title"),
        ws_trim(F.coalesce(x["description"], F.lit(""))).alias("description")))
    items = F.filter(shaped, lambda x: (F.length(x["title"]) > 0) & (F.length(x["description"]) > 0))
    if not with_default:
        return items
    default = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"), F.lit(dsc).alias("description"))
                        for i, t, dsc in DEFAULT_RECOMMENDATIONS])
    return F.when(F.size(items) > 0, items).otherwise(default)


def argmax(arr) -> Column:
    """AJ-05: 0-based index of the largest value (first on ties)."""
    a = as_col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def icon_for(key) -> Column:
    """AJ-06: icon key -> icon name."""
    m = F.create_map(*[x for k, v in ICONS for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, as_col(key))
