"""Zone-free time arithmetic."""

from pyspark.sql import Column, functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, independent of the session time zone."""
    gap = end - start
    whole = (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * 3600
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * 60
    )
    return whole + F.extract(F.lit("SECOND"), gap).cast("double")


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 3600


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def hour_bucket(time: Column) -> Column:
    """Start of the hour, zone-free."""
    return F.concat(F.substring(time.cast("string"), 1, 13), F.lit(":00:00")).cast("timestamp_ntz")
