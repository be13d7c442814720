"""Time functions: parsing, business hours, elapsed hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The business day, Monday to Friday, both ends included.
OPENING_HOUR = 9
CLOSING_HOUR = 17


def parse_time(text: Column, pattern: str | None = None, strict: bool = True) -> Column:
    """Text to a timestamp without zone. Bad text fails when ``strict``, else gives null."""
    if pattern is not None:
        return (F.to_timestamp_ntz if strict else _lenient)(text, F.lit(pattern))
    return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")


def _lenient(text: Column, pattern: Column) -> Column:
    return F.try_to_timestamp(text, pattern).cast("timestamp_ntz")


def business_roll_forward(time: Column, kind: str = "timestamp_ntz") -> Column:
    """The same time inside business hours, else the next opening.

    ``kind`` is the type of ``time``; calendar days are counted as dates, so no session
    zone comes into a zone-less time.
    """
    day = time.cast("date")
    weekday = F.weekday(day)

    def at(date: Column, hour: int) -> Column:
        return date.cast(kind) + F.make_dt_interval(F.lit(0), F.lit(hour))

    days_ahead = F.when(weekday < 4, 1).otherwise(7 - weekday)
    return (
        F.when((weekday < 5) & time.between(at(day, OPENING_HOUR), at(day, CLOSING_HOUR)), time)
        .when((weekday < 5) & (time < at(day, OPENING_HOUR)), at(day, OPENING_HOUR))
        .otherwise(at(F.date_add(day, days_ahead), OPENING_HOUR))
    )


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed wall-clock hours as a double, to the microsecond."""
    seconds = (end - start).cast("interval second").cast("decimal(24,6)")
    return seconds.cast("double") / 3600.0
