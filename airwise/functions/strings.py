"""Text column functions (STR-01 .. STR-14, FLT-07).

Regex-based parsing with built-in ``regexp_extract`` / ``rlike`` so the work
stays JVM-side.  Patterns below are fixed values of the data formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airwise.functions.dates import as_col

# Text formats.
ISO_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
LATLON_RE = r"^(-?\d+\.?\d*),(-?\d+\.?\d*)$"
ZIP_RE = r"^\d{5}(-\d{4})?$"
HEIGHT_CM_RE = r"(?i)^(\d+(?:\.\d+)?)\s*cm$"
HEIGHT_M_RE = r"(?i)^(\d+(?:\.\d+)?)\s*m$"
HEIGHT_FT_IN_RE = "(?i)^(\\d+)\\s*['’]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:[\"”]|in\\.?)?$"
HEIGHT_FT_RE = "(?i)^(\\d+)\\s*['’]?\\s*$"
WEIGHT_KG_RE = r"(?i)^(\d+(?:\.\d+)?)\s*kg$"
WEIGHT_LB_RE = r"(?i)^(\d+(?:\.\d+)?)\s*(?:lbs?|lb)?$"
LEADING_NUMBER_RE = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
EM_DASH = "—"


def ws_trim(c) -> Column:
    """Trim every kind of leading/trailing whitespace (JavaScript trim / Python strip);
    Spark's trim only removes spaces."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def _num_text(x: Column) -> Column:
    """Number as JavaScript prints it for short decimals: no trailing '.0'."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def location_key(lat, lon, zip_code) -> Column:
    """STR-01: 'lat_lon' with 4 zero-padded decimals; lat/lon before zip; else 'unknown'."""
    la, lo, z = as_col(lat), as_col(lon), as_col(zip_code)
    return (F.when(la.isNotNull() & lo.isNotNull(), F.format_string("%.4f_%.4f", la, lo))
            .when(z.isNotNull() & (z != ""), z)
            .otherwise(F.lit("unknown")))


def location_id(lat, lon, zip_code) -> Column:
    """STR-02: 'zip_<zip>' first, else round(lat,4)_round(lon,4) unpadded, else 'unknown'."""
    la, lo, z = as_col(lat), as_col(lon), as_col(zip_code)
    return (F.when(z.isNotNull() & (z != ""), F.concat(F.lit("zip_"), z))
            .when(la.isNotNull() & lo.isNotNull(),
                  F.concat_ws("_", F.round(la, 4).cast("string"), F.round(lo, 4).cast("string")))
            .otherwise(F.lit("unknown")))


def dash_form(loc_id) -> Column:
    """STR-03: drop '_' and spaces from a location id."""
    return F.regexp_replace(as_col(loc_id), r"[_ ]", "")


def undash_form(loc) -> Column:
    """STR-03 reverse: first '-' becomes '_'."""
    return F.regexp_replace(as_col(loc), r"^([^-]*)-", "$1_")


def two_dp_form(lat, lon) -> Column:
    """STR-03: 'lat-lon' with 2 decimals."""
    return F.format_string("%.2f-%.2f", as_col(lat), as_col(lon))


def parse_location(loc_id) -> Column:
    """STR-04: location id -> struct(lat, lon); zip or bad text -> (37.0, -122.0)."""
    parts = F.split(as_col(loc_id), "_")
    lat = F.element_at(parts, 1).try_cast("double")
    lon = F.element_at(parts, 2).try_cast("double")
    ok = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(ok, lat).otherwise(F.lit(37.0)).alias("lat"),
                    F.when(ok, lon).otherwise(F.lit(-122.0)).alias("lon"))


def text_to_location_id(text) -> Column:
    """STR-05: 'lat,lon' -> rounded id, ZIP/ZIP+4 -> 'zip_#####', blank -> null, else as is."""
    s = ws_trim(as_col(text))
    # Math.round(x * 1e4) / 1e4: half rounds toward +infinity on the binary product
    lat = F.floor(F.regexp_extract(s, LATLON_RE, 1).try_cast("double") * 10000 + 0.5) / 10000
    lon = F.floor(F.regexp_extract(s, LATLON_RE, 2).try_cast("double") * 10000 + 0.5) / 10000
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("string"))
            .when(s.rlike(LATLON_RE), F.concat(_num_text(lat), F.lit("_"), _num_text(lon)))
            .when(s.rlike(ZIP_RE), F.concat(F.lit("zip_"), F.substring(s, 1, 5)))
            .otherwise(s))


def height_in(text) -> Column:
    """STR-06: feet'inches" text -> inches; no ' -> null; unparsable -> null."""
    s = F.regexp_replace(F.lower(ws_trim(as_col(text))), " ", "")
    feet = F.substring_index(s, "'", 1).try_cast("double")
    after = F.substring(s, F.instr(s, "'") + 1, F.lit(100000))
    inches_txt = ws_trim(F.regexp_replace(after, '"', ""))
    inches = F.when(inches_txt == "", F.lit(0.0)).otherwise(inches_txt.try_cast("double"))
    return F.when(F.instr(s, "'") > 0, feet * 12.0 + inches)


def weight_lb(text) -> Column:
    """STR-07: '150 lbs' -> 150.0; bad -> null."""
    s = ws_trim(F.replace(F.replace(F.lower(as_col(text)), F.lit("lbs"), F.lit("")), F.lit("lb"), F.lit("")))
    return s.try_cast("double")


def height_m(text) -> Column:
    """STR-08: height text -> metres (cm, m, ft-in, ft only) with range checks."""
    s = ws_trim(as_col(text))
    cm = F.regexp_extract(s, HEIGHT_CM_RE, 1).try_cast("double")
    m = F.regexp_extract(s, HEIGHT_M_RE, 1).try_cast("double")
    ft = F.regexp_extract(s, HEIGHT_FT_IN_RE, 1).try_cast("int")
    inch = F.regexp_extract(s, HEIGHT_FT_IN_RE, 2).try_cast("double")
    ft_only = F.regexp_extract(s, HEIGHT_FT_RE, 1).try_cast("int")
    none = F.lit(None).cast("double")
    return (F.when(s.isNull() | (s == ""), none)
            .when(s.rlike(HEIGHT_CM_RE), F.when((cm > 0) & (cm < 300), cm / 100))
            .when(s.rlike(HEIGHT_M_RE), F.when((m > 0) & (m < 3), m))
            .when(s.rlike(HEIGHT_FT_IN_RE),
                  F.when(ft.between(2, 8) & (inch >= 0) & (inch < 12), ft * 0.3048 + inch * 0.0254))
            .when(s.rlike(HEIGHT_FT_RE), F.when(ft_only.between(2, 8), ft_only * 0.3048))
            .otherwise(none))


def weight_kg(text) -> Column:
    """STR-09: weight text -> kg (kg, lb or bare number, other leading number)."""
    s = ws_trim(as_col(text))
    kg = F.regexp_extract(s, WEIGHT_KG_RE, 1).try_cast("double")
    lb = F.regexp_extract(s, WEIGHT_LB_RE, 1).try_cast("double")
    lead = F.regexp_extract(s, LEADING_NUMBER_RE, 1).try_cast("double")
    none = F.lit(None).cast("double")
    return (F.when(s.isNull() | (s == ""), none)
            .when(s.rlike(WEIGHT_KG_RE), F.when((kg > 0) & (kg < 500), kg))
            .when(s.rlike(WEIGHT_LB_RE), F.when((lb > 0) & (lb < 1500), lb / 2.205))
            .when(lead.isNull() | (lead <= 0), none)
            .when(lead < 150, lead)
            .otherwise(lead / 2.205))


def slug(text, index) -> Column:
    """STR-10: spaces -> '-', lower, strip other chars; empty -> 'rec-<i>'."""
    s = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(as_col(text), F.lit("")), r"\s+", "-")),
                         r"[^a-z0-9-]", "")
    return F.when(s == "", F.concat(F.lit("rec-"), as_col(index).cast("string"))).otherwise(s)


def chat_role(role) -> Column:
    """STR-11: 'model'/'assistant' -> 'model', everything else -> 'user'."""
    r = as_col(role)
    return F.when(r.isin("model", "assistant"), F.lit("model")).otherwise(F.lit("user"))


def dash_if_null(c, fmt: str | None = None) -> Column:
    """STR-12: value text, '—' when null."""
    c = as_col(c)
    txt = F.format_string(fmt, c) if fmt else c.cast("string")
    return F.coalesce(txt, F.lit(EM_DASH))


def display_name(name) -> Column:
    """STR-13: trimmed name, 'there' when blank."""
    return F.coalesce(F.nullif(ws_trim(as_col(name)), F.lit("")), F.lit("there"))


def _c_to_f_text(c: Column) -> Column:
    """Celsius -> Fahrenheit rounded half up (toward +inf), as integer text."""
    return F.floor(c * 9.0 / 5.0 + 32 + 0.5).cast("long").cast("string")


def _fixed1(c: Column) -> Column:
    """One-decimal text with ties rounded up (toFixed(1) for non-negative values)."""
    return (F.floor(c * 10 + 0.5) / 10).cast("string")


def temp_range_text(tmin, tmax) -> Column:
    """STR-14: '°F' range from the non-null Celsius ends ('a–b°F'); null when both are null."""
    parts = F.filter(F.array(_c_to_f_text(as_col(tmin)), _c_to_f_text(as_col(tmax))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "–"), F.lit("°F")))


def pm_text(mean, mx) -> Column:
    """STR-14: 'Avg x, high y' / 'Avg x' / 'High y' / '—' with one decimal."""
    m, x = as_col(mean), as_col(mx)
    return (F.when(m.isNotNull() & x.isNotNull(), F.concat(F.lit("Avg "), _fixed1(m), F.lit(", high "), _fixed1(x)))
            .when(m.isNotNull(), F.concat(F.lit("Avg "), _fixed1(m)))
            .when(x.isNotNull(), F.concat(F.lit("High "), _fixed1(x)))
            .otherwise(F.lit(EM_DASH)))


def is_iso_date(c) -> Column:
    """FLT-07: YYYY-MM-DD text."""
    return F.coalesce(as_col(c).rlike(ISO_DATE_RE), F.lit(False))


def js_number(c) -> Column:
    """A number as JavaScript template text prints it (integers without '.0'), '—' for null."""
    return F.coalesce(_num_text(as_col(c)), F.lit(EM_DASH))


def day_line(date_txt, dow, label, score, factor_labels, aqi, pm, tmin, tmax, hum, tree, grass, weed) -> Column:
    """STR-12 / AG-24: one forecast day as the assistant context line, '—' for missing parts."""
    t = lambda c: F.coalesce(as_col(c).cast("string"), F.lit(EM_DASH))
    factors = F.coalesce(F.nullif(F.array_join(as_col(factor_labels), ", "), F.lit("")), F.lit(EM_DASH))
    return F.concat(
        F.lit("- "), t(date_txt), F.lit(" ("), t(dow), F.lit("): Risk "), t(label), F.lit(" (score "),
        js_number(score), F.lit("). Factors: "), factors, F.lit(". AQI: "), js_number(aqi),
        F.lit(", PM2.5 mean: "), js_number(pm), F.lit(", temp: "), js_number(tmin), F.lit("–"), js_number(tmax),
        F.lit(" °C, humidity: "), js_number(hum), F.lit("%. Pollen: tree "), js_number(tree), F.lit(", grass "),
        js_number(grass), F.lit(", weed "), js_number(weed), F.lit("."))
