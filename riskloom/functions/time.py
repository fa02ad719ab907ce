"""Functions of event time. Day keys are day numbers, so frames cross month ends correctly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.amount import bool_double
from riskloom.schema import NIGHT_HOURS

__all__ = [
    "parse_time", "day_no", "month_of", "day_of_week", "is_weekend", "hour_of", "is_night", "micros",
    "time_delta", "minutes_since", "hours_since", "interval_bucket",
]

_UNIT_SECONDS = {"seconds": 1, "mins": 60, "hours": 3600}


def parse_time(text: Column, fmt: str = "yyyyMMddHHmmss", year: int | None = None) -> Column:
    """Timestamp from a digit string; ``year`` completes the short form without one. Bad text gives null."""
    if year is not None:
        return F.try_to_timestamp(F.concat(F.lit(str(year)), text), F.lit("yyyy" + fmt))
    return F.try_to_timestamp(text, F.lit(fmt))


def day_no(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def month_of(ts: Column) -> Column:
    return F.month(ts)


def day_of_week(ts: Column) -> Column:
    """Monday 1 .. Sunday 7."""
    return F.weekday(ts) + 1


def is_weekend(ts: Column) -> Column:
    return bool_double(day_of_week(ts).isin(6, 7))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def is_night(ts: Column) -> Column:
    return bool_double(F.hour(ts).isin(*NIGHT_HOURS))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, the numeric key of every time frame."""
    return F.unix_micros(ts.cast("timestamp"))


def time_delta(later: Column, earlier: Column, unit: str = "seconds") -> Column:
    """``later - earlier`` as a double; null when either side is unknown."""
    return (micros(later) - micros(earlier)) / F.lit(float(_UNIT_SECONDS[unit] * 1_000_000))


def _since(ts: Column, anchor: str, seconds: int) -> Column:
    start = F.lit(anchor).cast("timestamp_ntz")
    return (micros(ts) - micros(start)) / F.lit(float(seconds * 1_000_000))


def minutes_since(ts: Column, anchor: str = "1970-01-01 00:00:00") -> Column:
    return _since(ts, anchor, 60)


def hours_since(ts: Column, anchor: str = "1970-01-01 00:00:00") -> Column:
    return _since(ts, anchor, 3600)


def interval_bucket(minutes: Column) -> Column:
    """Steps at 1, 2, 5, 10 and 60 minutes; an unknown interval stays null."""
    bucket = F.when(minutes.isNull(), F.lit(None).cast("int"))
    for step, edge in enumerate([1, 2, 5, 10, 60]):
        bucket = bucket.when(minutes <= edge, F.lit(step))
    return bucket.otherwise(F.lit(5))
