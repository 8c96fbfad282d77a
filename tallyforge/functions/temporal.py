"""Wall-clock time helpers.

Everything here reads the fields of the timestamp rather than its epoch, so zone-less
timestamps give the same answer under any session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tried in order after the ISO forms; month-first wins over day-first.
UPLOAD_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M-d-yyyy",
    "M-d-yyyy H:mm",
    "d/M/yyyy",
    "d/M/yyyy H:mm",
    "d/M/yyyy H:mm:ss",
    "d-M-yyyy",
    "d-M-yyyy H:mm",
    "yyyy/M/d",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "MMM d, yyyy",
    "d MMM yyyy",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall_seconds(ts: Column | str) -> Column:
    ts = _col(ts)
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def wall_micros(ts: Column | str) -> Column:
    ts = _col(ts)
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    whole = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * 1000000 + (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")


def hour_chunk(ts: Column | str) -> Column:
    """Running number of the hour the time falls in; NULL for no time."""
    ts = _col(ts)
    return F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed hours, NULL while either end is missing."""
    return (wall_micros(end) - wall_micros(start)).cast("double") / F.lit(3.6e9)


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Full 24-hour periods elapsed, which is not the same as calendar days."""
    return F.floor((wall_micros(end) - wall_micros(start)) / F.lit(86400000000)).cast("bigint")


def parse_ntz(text: Column | str) -> Column:
    """ISO text to a zone-less timestamp, NULL when it does not parse."""
    return _col(text).try_cast("timestamp_ntz")


def parse_any(text: Column | str, formats: Sequence[str] = UPLOAD_FORMATS) -> Column:
    """First of the ISO form and ``formats`` that parses, else NULL."""
    text = F.trim(_col(text))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(parse_ntz(text), *tries)


def to_second_text(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with any fraction cut off."""
    return F.substring(_col(ts).cast("string"), 1, 19)


def iso_day_of_week(day: Column | str) -> Column:
    """Monday = 1 to Sunday = 7."""
    return F.weekday(_col(day)) + 1


def is_payday(day: Column | str) -> Column:
    # Paydays of the month.
    return F.dayofmonth(_col(day)).isin(1, 15, 30, 31)


def is_retail_event(day: Column | str) -> Column:
    day = _col(day)
    month, dom = F.month(day), F.dayofmonth(day)
    # 4 July; 24, 25 and 31 December; 1 January; 23 to 29 November.
    return (
        ((month == 7) & (dom == 4))
        | ((month == 12) & dom.isin(24, 25, 31))
        | ((month == 1) & (dom == 1))
        | ((month == 11) & dom.between(23, 29))
    )
