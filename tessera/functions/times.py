"""Times without a zone that mean UTC; local time is a fixed offset (the zone has no summer time)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HOURS = 7


def local_time(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def local_day(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return local_time(ts, hours).cast("date")


def iso_local(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return F.concat(F.date_format(local_time(ts, hours), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"+{hours:02d}:00"))


def minute_key(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyyMMddHHmm")


def day_key(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyyMMdd")


def month_key(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyyMM")


def seconds_to_midnight(ts: Column, spare: int = 60) -> Column:
    """Seconds to the next local midnight, and some to spare."""
    t = local_time(ts)
    return (86400 - (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) + spare).cast("long")


def since(ts: Column, now: Column, days: int) -> Column:
    """Not older than so many days; the boundary counts."""
    return ts >= now - F.make_dt_interval(days=F.lit(days))
