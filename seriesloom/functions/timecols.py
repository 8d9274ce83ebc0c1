"""Date and time Columns that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000

# Date layouts tried after the ISO forms, in this order.
DATE_LAYOUTS = ("M/d/yyyy", "d-MMM-yyyy", "MMM d yyyy", "MMM d, yyyy", "yyyy/M/d", "yyyyMMdd")


def parse_when(text: Column) -> Column:
    """Text to timestamp, null when no known layout fits. Never raises."""
    iso = text.try_cast("timestamp_ntz")
    rest = [F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in DATE_LAYOUTS]
    return F.coalesce(iso, *rest)


def day_number(when: Column) -> Column:
    return F.unix_date(when.cast("date"))


def micros_of_day(when: Column) -> Column:
    stamp = when.cast("timestamp_ntz")
    whole = F.hour(stamp).cast("bigint") * 3_600_000_000 + F.minute(stamp).cast("bigint") * 60_000_000
    return whole + (F.date_part(F.lit("SECOND"), stamp) * 1_000_000).cast("bigint")


def micros(when: Column) -> Column:
    """Microseconds since 1970, read as wall-clock time."""
    return day_number(when).cast("bigint") * F.lit(MICROS_PER_DAY) + micros_of_day(when)


def is_month_end(day: Column) -> Column:
    return (day == F.last_day(day)).cast("int")


def is_month_start(day: Column) -> Column:
    return (F.dayofmonth(day) == 1).cast("int")


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")
