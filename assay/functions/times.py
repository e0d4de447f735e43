"""Times as numbers, independent of the session's time zone.

A TIMESTAMP is an instant. A TIMESTAMP_NTZ is a wall clock: it is taken apart
field by field, since a cast would move it through the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_SECONDS = 86_400


def wall_seconds(wall: Column) -> Column:
    """Whole seconds from 1970-01-01 00:00 on the clock the wall time was read on."""
    day = F.unix_date(wall.cast("date")).cast("long")
    return day * DAY_SECONDS + F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)


def wall_micros(wall: Column) -> Column:
    """`wall_seconds` to the microsecond."""
    fraction = F.extract(F.lit("SECOND"), wall) - F.second(wall)
    return wall_seconds(wall) * 1_000_000 + (fraction * 1_000_000).cast("long")


def micros(value: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp, wall time (as UTC) or date."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long") * (DAY_SECONDS * 1_000_000)
    return wall_micros(value)


def seconds(value: Column, dtype: T.DataType) -> Column:
    """Whole seconds since 1970 of a timestamp, wall time (as UTC) or date."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(value)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long") * DAY_SECONDS
    return wall_seconds(value)


def to_utc(wall: Column, zone: str = "UTC") -> Column:
    """A wall time of `zone` as the wall time in UTC."""
    return wall if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def day_number(value: Column, dtype: T.DataType) -> Column:
    """Whole UTC days since 1970."""
    if isinstance(dtype, T.TimestampType):
        return F.floor(F.unix_seconds(value) / F.lit(DAY_SECONDS)).cast("long")
    return F.unix_date(value.cast("date")).cast("long")


def newest_instant(newest: Column, dtype: T.DataType, zone: str) -> Column:
    """The newest value of a column as microseconds since 1970 UTC.

    Dates are midnight and wall times are clock readings in `zone`. Text is
    read as ISO-8601 with or without an offset; other text gives NULL.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(newest)
    if isinstance(dtype, T.DateType):
        return wall_micros(to_utc(newest.cast("timestamp_ntz"), zone))
    if isinstance(dtype, T.TimestampNTZType):
        return wall_micros(to_utc(newest, zone))
    has_offset = newest.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$")
    zoned = F.when(has_offset, F.unix_micros(newest.try_cast("timestamp")))
    wall = wall_micros(to_utc(newest.try_cast("timestamp_ntz"), zone))
    return F.when(has_offset, zoned).otherwise(wall)


def age_seconds(now_micros: Column, then_micros: Column) -> Column:
    return (now_micros - then_micros) / F.lit(1e6)


# How far ahead of now a value may be before it is noted, and how
# far a wrong time zone can shift one (UTC+14 against UTC-12).
CLOCK_SKEW_SECONDS = 60
ZONE_REACH_SECONDS = 26 * 3600


def future_kind(age: Column) -> Column:
    """Why the newest value lies ahead of now: NULL, `zone` or `placeholder`."""
    return F.when(age >= -CLOCK_SKEW_SECONDS, F.lit(None).cast("string")).otherwise(
        F.when(age >= -ZONE_REACH_SECONDS, "zone").otherwise("placeholder")
    )
