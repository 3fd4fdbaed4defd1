"""Calendar column functions (DT-01 .. DT-08).

All functions take and return Columns, so they stay inside whole-stage
codegen; nothing here touches Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in Monday-first order, season names by
# month group (Dec-Feb, Mar-May, Jun-Aug, Sep-Nov).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEASON_NAMES = ["winter", "spring", "summer", "fall"]

# US holidays used by the time context.  Fixed-date ones as
# (month, day); rule-based ones as (month, weekday 0=Mon, nth occurrence).
# Memorial Day and Juneteenth are deliberately absent (kept as observed).
FIXED_HOLIDAYS = [(1, 1), (7, 4), (11, 11), (12, 25)]
NTH_WEEKDAY_HOLIDAYS = [
    (1, 0, 3),   # third Monday of January
    (2, 0, 3),   # third Monday of February
    (9, 0, 1),   # first Monday of September
    (10, 0, 2),  # second Monday of October
    (11, 3, 4),  # fourth Thursday of November
]
_DOW_ABBR = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_name(d) -> Column:
    """DT-01: English weekday name (Monday ..)."""
    return F.date_format(as_col(d), "EEEE")


def weekday_num(d) -> Column:
    """DT-01: weekday number, 0 = Monday."""
    return F.weekday(as_col(d))


def season_name(month, fall_word: str = "fall") -> Column:
    """DT-02: season name from the month number (Q2: canonical 'fall')."""
    m = as_col(month)
    return (F.when(m.isin(12, 1, 2), F.lit("winter"))
            .when(m.isin(3, 4, 5), F.lit("spring"))
            .when(m.isin(6, 7, 8), F.lit("summer"))
            .otherwise(F.lit(fall_word)))


def season_num(month, zero_based: bool = False) -> Column:
    """DT-03: 1 = winter .. 4 = fall; zero_based gives 0..3."""
    n = F.floor((F.pmod(as_col(month), F.lit(12)) + 3) / 3).cast("int")
    return n - 1 if zero_based else n


def nth_weekday(year, month: int, weekday: int, n: int) -> Column:
    """DT-04: date of the n-th given weekday (0 = Mon) of year/month."""
    first = F.make_date(as_col(year), F.lit(month), F.lit(1))
    first_hit = F.next_day(F.date_sub(first, 1), _DOW_ABBR[weekday])
    return F.date_add(first_hit, 7 * (n - 1))


def is_us_holiday(d) -> Column:
    """DT-05: holiday flag from fixed dates and n-th weekday rules."""
    d = as_col(d)
    y = F.year(d)
    fixed = F.lit(False)
    for m, day in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(d) == m) & (F.dayofmonth(d) == day))
    ruled = F.lit(False)
    for m, wd, n in NTH_WEEKDAY_HOLIDAYS:
        ruled = ruled | (d == nth_weekday(y, m, wd, n))
    return fixed | ruled


def time_context(d, fall_word: str = "autumn") -> Column:
    """DT-06: the time-context struct of a date."""
    d = as_col(d)
    return F.struct(
        weekday_name(d).alias("day_of_week"),
        weekday_num(d).alias("day_of_week_num"),
        season_name(F.month(d), fall_word).alias("season"),
        is_us_holiday(d).alias("is_holiday"),
        F.lit("Derived").alias("source"),
        F.lit(None).cast("string").alias("error"),
    )


def interval_start_date(valid_time) -> Column:
    """DT-07: date of an ISO-8601 'start/duration' interval in its own offset."""
    return F.to_date(F.substring(as_col(valid_time), 1, 10))


def to_utc_date(c) -> Column:
    """DT-08: ISO text or timestamp to a date (UTC midnight)."""
    c = as_col(c)
    return F.to_date(c)


def iso_ordinal(d) -> Column:
    """Proleptic Gregorian ordinal (0001-01-01 = 1) of a date."""
    return F.unix_date(as_col(d)) + F.lit(719163)
