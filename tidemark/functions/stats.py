"""Statistics as Columns. Null means "not known": no zero, no infinity stands in for it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schemas import PERIOD_FACTOR


def percent_change(current: Column, previous: Column) -> Column:
    return F.try_divide(100.0 * (current - previous), previous)


def share(part: Column, whole: Column) -> Column:
    """part / whole clamped to 0..1; 0 if whole isn't positive."""
    return F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole))).otherwise(F.lit(0.0))


def confidence(n: Column, full: int = 50) -> Column:
    return F.least(F.lit(1.0), F.log1p(n) / math.log1p(full))


def coefficient_of_variation(sd: Column, mean: Column) -> Column:
    return F.coalesce(F.try_divide(sd, F.abs(mean)), F.lit(0.0))


def z_score(value: Column, over: WindowSpec | None = None) -> Column:
    """Against the population of the window; null if it has under two values or no spread."""
    over = over or Window.partitionBy()
    spread = F.stddev_pop(value).over(over)
    return F.when(F.count(value).over(over) >= 2, F.try_divide(value - F.avg(value).over(over), spread))


def moving_average(value: Column, order: WindowSpec, width: int) -> Column:
    """Trailing mean with a partial head."""
    return value.cast("double") if width <= 1 else F.avg(value).over(order.rowsBetween(-(width - 1), 0))


def slope(y: str, index: str) -> Column:
    """Aggregate: least-squares slope, 0 for under two points."""
    return F.coalesce(F.when(F.count(y) >= 2, F.regr_slope(F.col(y), F.col(index))), F.lit(0.0))


def trend(change: Column, cv: Column, points: Column, rising: float = 10.0, declining: float = -10.0, volatile: float = 0.6, least: int = 5) -> Column:
    """Direction of a change: too few points first, then volatility around a small change, then the sign."""
    return (
        F.when(change.isNull() | (points < least), "insufficient_data")
        .when((cv > volatile) & (F.abs(change) < 30.0), "volatile")
        .when(change >= rising, "rising").when(change <= declining, "declining").otherwise("stable")
    )


def association(support: Column, lift: Column) -> Column:
    return F.when(lift > 0, F.log1p(lift) * F.sqrt(support)).otherwise(F.lit(0.0))


def annualised(amount: Column, period: Column) -> Column:
    factor = F.create_map(*[x for k, v in PERIOD_FACTOR.items() for x in (F.lit(k), F.lit(v))])
    return amount * F.try_element_at(factor, period)


def midpoint(low: Column, high: Column) -> Column:
    return (F.coalesce(low, high) + F.coalesce(high, low)) / 2


def calendar(df: DataFrame, start: str, end: str) -> DataFrame:
    """All days between two ISO dates, both included."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def dense_days(counts: DataFrame, start: str, end: str, keys: DataFrame | None = None) -> DataFrame:
    """``counts`` (keys, day, n) with a row for each day of each key, 0 where it has none."""
    days = calendar(counts, start, end)
    on = [*(keys.columns if keys is not None else []), "day"]
    if keys is not None:  # a stated small set of days beside each key
        days = keys.withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return days.join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
