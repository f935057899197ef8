"""Dates and times as Columns; a session in UTC is assumed, naive values are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy")


def parse_datetime(c: Column) -> Column:
    """ISO, epoch seconds or milliseconds, several day formats, RFC 2822; null for anything else."""
    s = F.trim(c.cast("string"))
    digits = lambda n: F.rlike(s, F.lit(rf"^\d{{{n}}}$"))
    epoch = F.when(digits(10), F.timestamp_seconds(F.try_to_number(s, F.lit("9999999999")))).when(digits(13), F.timestamp_millis(F.try_to_number(s, F.lit("9999999999999")).cast("long")))
    iso = F.when(F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")), s.try_cast("timestamp"))
    mail = F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    zone = F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(epoch, iso, *[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS], mail, zone)


def utc(c: Column) -> Column:
    """Naive timestamps count as UTC."""
    return c.cast("timestamp")


def day_start(c: Column) -> Column:
    return F.date_trunc("day", c)


def days_before(c: Column, days: int) -> Column:
    return c - F.make_dt_interval(days=F.lit(days))


def partition_parts(c: Column) -> list[Column]:
    return [F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day")]


def age_days(c: Column, as_of: Column) -> Column:
    """Whole elapsed days, not calendar days."""
    return F.floor((as_of.cast("timestamp").cast("double") - c.cast("timestamp").cast("double")) / 86400)


def isoformat(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def humanize_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("long"), F.lit("ms"))).when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(seconds % 60)))
        .otherwise(F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)))
    )
