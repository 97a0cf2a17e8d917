"""Time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(moment: Column, tz: str | None = None) -> Column:
    """Wall-clock time in ``tz``; without ``tz`` the session zone, no conversion.

    TIMESTAMP values are instants, TIMESTAMP_NTZ values count as session time.
    """
    if tz is None:
        return moment
    return F.convert_timezone(F.current_timezone(), F.lit(tz), moment.cast("timestamp_ntz"))


def day(moment: Column, tz: str | None = None) -> Column:
    return F.to_date(local_time(moment, tz))


def hour_of_day(moment: Column, tz: str | None = None) -> Column:
    return F.hour(local_time(moment, tz)).cast("int")


def hour_index(moment: Column, tz: str | None = None) -> Column:
    """Hours since 1970-01-01 00:00 as BIGINT."""
    local = local_time(moment, tz)
    return F.unix_date(F.to_date(local)).cast("bigint") * 24 + F.hour(local)


def hour_start(index: Column) -> Column:
    """Inverse of :func:`hour_index`, as TIMESTAMP_NTZ."""
    hours = F.make_dt_interval(hours=index.cast("int"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + hours
