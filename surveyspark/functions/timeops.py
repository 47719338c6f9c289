"""Time expressions over wall-clock timestamps (`timestamp_ntz`)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("bigint")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def shift_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(seconds))


def night_date(ts: Column, start_hour: int = 7) -> Column:
    """Survey night of a moment: everything before the morning boundary belongs to yesterday."""
    return (ts - F.expr(f"INTERVAL '{int(start_hour)}' HOUR")).cast("date")


def night_key(ts: Column, start_hour: int = 7) -> Column:
    return night_date(ts, start_hour).cast("string")


def bin_start(ts: Column, minutes: int = 10) -> Column:
    width = minutes * 60 * MICROS
    return from_micros(F.floor(micros(ts) / F.lit(width)) * F.lit(width))


def local_wall_time(instant: Column, zone: str = "Asia/Tokyo") -> Column:
    """Wall time of a zoned instant; used once, where data enters."""
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def clock_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def cyclic_hour(ts: Column) -> tuple[Column, Column, Column]:
    hour = clock_hour(ts)
    angle = hour * F.lit(2 * math.pi / 24)
    return hour, F.sin(angle), F.cos(angle)


def activity_time(kind: Column, observed_at: Column, presence_at: Column) -> Column:
    """A road find tells when it was found, not when the animal was there."""
    return F.when(kind == "road_event", presence_at).otherwise(observed_at)
