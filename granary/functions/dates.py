"""Column functions over periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Days of a quarter, half, nine months and year in calendars of 52 or 53 weeks.
PERIODS = {"Q": (80, 100), "H": (170, 190), "9M": (260, 285), "FY": (340, 380)}


def period_kind(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.coalesce(*(F.when(days.between(*span), F.lit(kind)) for kind, span in PERIODS.items()))


def fiscal_year(end: Column, last_month: Column) -> Column:
    return (F.year(end) + F.when(F.month(end) > last_month, 1).otherwise(0)).cast("int")


def fiscal_quarter(end: Column, last_month: Column) -> Column:
    return (F.floor(F.pmod(F.month(end) - last_month - 1, F.lit(12)) / 3) + 1).cast("int")


def calendar_label(form: Column, report: Column) -> Column:
    """FY2026 of a 10-K, FY2026Q3 of other forms, by the calendar."""
    year = F.concat(F.lit("FY"), F.year(report).cast("string"))
    return F.when(report.isNull(), F.lit("")).when(form == "10-K", year).otherwise(F.concat(year, F.lit("Q"), F.quarter(report).cast("string")))


def period_label(year: Column, quarter: Column) -> Column:
    return F.concat(F.lit("FY"), year.cast("string"), F.when(quarter > 0, F.concat(F.lit("Q"), quarter.cast("string"))).otherwise(F.lit("")))


def pct_change(now: Column, before: Column) -> Column:
    """Null where there is nothing before, or zero."""
    return F.try_divide(F.lit(100.0) * (now - before), F.abs(F.nullif(before, F.lit(0.0))))


def epoch_seconds(day: Column) -> Column:
    """Midnight UTC of a date in seconds since 1970."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Zones that RFC 822 names, in hours from UTC; others are taken as UTC.
ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
_MAIL = r"^\s*(?:[A-Za-z]+\.?,?\s*)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?)?\s*([A-Za-z]{1,5}|[+-]\d{2}:?\d{2})?\s*(?:\(.*\))?\s*$"
_ISO = r"^\s*(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}(?::\d{2})?)(?:[.,]\d+)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?\s*$"


def feed_time(text: Column) -> Column:
    """The moment that a date of RFC 822 or ISO 8601 names, to the second, UTC where no zone stands; null for others.

    Years of two digits are 1950 to 2049; 'Mon,' and the like are not compared with the day.
    """
    day, month, year, hour, minute, second, zone = (F.regexp_extract(text, _MAIL, k) for k in range(1, 8))
    nth = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(month))
    full = F.when(F.length(year) == 4, year).when(year < "50", F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    two = lambda c: F.lpad(c, 2, "0")
    named = F.coalesce(*(F.when(F.lower(zone) == z, F.lit(f"-{-h:02d}:00")) for z, h in ZONES.items()), F.lit("Z"))
    offset = lambda z, other: F.when(z.rlike(r"^[+-]"), F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, -2, 2))).otherwise(other)
    mail = F.concat(full, F.lit("-"), two(nth.cast("string")), F.lit("-"), two(day), F.lit("T"), two(hour), F.lit(":"), F.rpad(minute, 2, "0"), F.lit(":"), F.rpad(second, 2, "0"), offset(zone, named))
    date, clock, shift = (F.regexp_extract(text, _ISO, k) for k in (1, 2, 3))
    iso = F.concat(date, F.lit("T"), F.when(clock == "", F.lit("00:00")).otherwise(clock), F.when(F.length(clock) < 8, F.lit(":00")).otherwise(F.lit("")), offset(shift, F.lit("Z")))
    return F.when(text.rlike(_ISO), iso.try_cast("timestamp")).when(text.rlike(_MAIL) & (nth > 0), mail.try_cast("timestamp"))
