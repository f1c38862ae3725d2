"""Date parsing and age arithmetic.

``as_of`` is always a parameter (a timestamp literal or column), never
``current_timestamp()`` inside a rule, so results are reproducible.
Assumes the session time zone is UTC (``session.BASE_CONF``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions.hosts import strip_ws

MICROS_PER_DAY = 86_400_000_000


def as_of_lit(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


# Accepted ISO-8601 forms: calendar date (extended or basic) or week date, then optionally one separator
# character, a time (extended or basic, two digits each, 3 or 6 decimals of any length) and an offset.
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(?:-?[1-7])?)"
_TIME = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
ISO_RE = f"^{_DATE}(?:.{_TIME}{_OFFSET}?)?$"


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, null on failure; ``Z`` and no offset mean UTC.

    Only the anchored forms above count: no years or months alone, no single
    digits, no zone names.  A week date without a day is its Monday.
    """
    s = strip_ws(c)
    part = lambda i: F.regexp_extract(s, ISO_RE, i)
    date, time, offset = part(1), part(2), part(3)
    week = date.contains("W")
    year, number = F.substring(date, 1, 4), F.regexp_extract(date, r"W(\d{2})", 1)
    day = F.regexp_extract(date, r"W\d{2}-?([1-7])$", 1)
    # the week that holds January 4th is the first
    fourth = F.try_to_timestamp(F.concat(year, F.lit("-01-04")), F.lit("yyyy-MM-dd")).cast("date")
    monday = F.date_add(F.date_trunc("week", fourth).cast("date"), (F.try_to_number(F.nullif(number, F.lit("")), F.lit("99")).cast("int") - 1) * 7)
    week_day = F.date_add(monday, F.coalesce(F.try_to_number(F.nullif(day, F.lit("")), F.lit("9")).cast("int"), F.lit(1)) - 1)
    last_week = F.weekofyear(F.try_to_timestamp(F.concat(year, F.lit("-12-28")), F.lit("yyyy-MM-dd")))
    in_year = (F.try_to_number(F.nullif(number, F.lit("")), F.lit("99")) >= 1) & (F.try_to_number(F.nullif(number, F.lit("")), F.lit("99")) <= last_week)
    plain = F.try_to_timestamp(F.regexp_replace(date, "-", ""), F.lit("yyyyMMdd")).cast("date")
    start = F.when(week, F.when(in_year, week_day)).otherwise(plain)
    clock = F.regexp_replace(F.regexp_replace(time, ":", ""), ",", ".")
    digits, fraction = F.regexp_extract(clock, r"^(\d*)", 1), F.regexp_extract(clock, r"\.(\d+)", 1)
    two = lambda x, at: F.coalesce(F.try_to_number(F.nullif(F.substring(x, at, 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    hour, minute, second = two(digits, 1), two(digits, 3), two(digits, 5)
    micros = F.coalesce(F.try_to_number(F.nullif(F.rpad(F.substring(fraction, 1, 6), 6, "0"), F.lit("000000")), F.lit("999999")).cast("long"), F.lit(0))
    plus = F.regexp_replace(offset, ":", "")
    seconds = F.when(plus.startswith("-"), -1).otherwise(1) * (two(plus, 2) * 3600 + two(plus, 4) * 60 + two(plus, 6))
    seconds = F.when(plus.isin("", "Z"), F.lit(0)).otherwise(seconds)
    ok = (date != "") & (hour < 24) & (minute < 60) & (second < 60) & (F.abs(seconds) < 86400)
    total = F.unix_micros(start.cast("timestamp")) + ((hour * 3600 + minute * 60 + second - seconds).cast("long") * 1_000_000) + micros
    return F.when(ok, F.timestamp_micros(total))


def parse_cert_date(c: Column) -> Column:
    """``Mon d HH:MM:SS YYYY GMT`` (whitespace runs collapsed), forced UTC; null if malformed."""
    s = F.regexp_replace(strip_ws(c), "\\s+", " ")
    ok = s.rlike("^[A-Za-z]{3} \\d{1,2} \\d{1,2}:\\d{2}:\\d{2} \\d{4} (?i:GMT|UTC)$")
    body = F.regexp_replace(s, " [A-Za-z]+$", "")
    return F.when(ok, F.try_to_timestamp(body, F.lit("MMM d H:mm:ss yyyy")))


def age_days(t: Column, as_of: Column) -> Column:
    """Whole days elapsed: floor of elapsed microseconds / one day (negative in the future)."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(t)) / F.lit(MICROS_PER_DAY)).cast("int")
