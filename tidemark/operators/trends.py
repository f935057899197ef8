"""Trends of all skills at once: windows against the windows before, without a dense grid in memory.

A day's offset from the reference day is 0 for the reference day itself; a window of d days holds offsets
0..d-1, the one before it d..2d-1. Zeros of the dense series enter mean and spread by its known length.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import skills as sk


def _series(jobs: DataFrame, bridge: DataFrame, as_of: date, longest: int) -> DataFrame:
    """(slug, back, n): days back from the reference day, of the 2 * longest + 1 days that count."""
    first, last = as_of - timedelta(days=2 * longest), as_of + timedelta(days=1)
    inside = jobs.filter((F.col("e") >= F.lit(str(first)).cast("timestamp")) & (F.col("e") < F.lit(str(last)).cast("timestamp")))
    return sk.daily(inside, bridge).select("slug", F.date_diff(F.lit(str(as_of)).cast("date"), "day").alias("back"), "n")


def _spread(n: Column, inside: Column, length: int) -> tuple[Column, Column]:
    """Mean and population deviation of a series of ``length`` days whose other days are 0."""
    total = F.coalesce(F.sum(F.when(inside, n)), F.lit(0)).cast("double")
    square = F.coalesce(F.sum(F.when(inside, n * n)), F.lit(0)).cast("double")
    mean = total / length
    return mean, F.sqrt(F.greatest(F.lit(0.0), square / length - mean * mean))


def windows(jobs: DataFrame, bridge: DataFrame, as_of: date, days: tuple[int, ...] = (7, 30, 90), least: int = 5) -> DataFrame:
    """(slug, days, current, previous, change, cv, direction): a row for each skill and window."""
    longest = max(days)
    series = _series(jobs, bridge, as_of, longest)
    aggs = []
    for d in sorted(days):
        inside = F.col("back") < d
        mean, sd = _spread(F.col("n"), inside, min(d, 2 * longest + 1))
        aggs.append(F.struct(
            F.lit(d).alias("days"),
            F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("current"),
            F.coalesce(F.sum(F.when((F.col("back") >= d) & (F.col("back") < 2 * d), F.col("n"))), F.lit(0)).alias("previous"),
            F.count_if(inside).alias("points"), mean.alias("mean"), sd.alias("sd"),
        ))
    wide = series.groupBy("slug").agg(F.array(*aggs).alias("w")).select("slug", F.inline("w"))
    change = stats.percent_change(F.col("current"), F.col("previous"))
    cv = stats.coefficient_of_variation(F.col("sd"), F.col("mean"))
    return wide.select("slug", "days", "current", "previous", change.alias("change"), cv.alias("cv"), stats.trend(change, cv, F.col("points"), least=least).alias("direction"))


def headline(found: DataFrame) -> DataFrame:
    """The 30-day window of each skill, else its longest."""
    return found.groupBy("slug").agg(F.max_by(F.struct("days", "current", "previous", "change", "direction"), F.when(F.col("days") == 30, F.lit(1 << 30)).otherwise(F.col("days"))).alias("h")).select("slug", "h.*")


def summary(jobs: DataFrame, bridge: DataFrame, as_of: date, days: tuple[int, ...] = (7, 30, 90), width: int = 7) -> DataFrame:
    """(slug, sample, volatility, moving_average, confidence) of the whole dense series."""
    longest = max(days)
    series = _series(jobs, bridge, as_of, longest)
    mean, sd = _spread(F.col("n"), F.lit(True), 2 * longest + 1)
    last = F.coalesce(F.sum(F.when(F.col("back") < width, F.col("n"))), F.lit(0)) / width
    wide = series.groupBy("slug").agg(F.sum("n").alias("sample"), mean.alias("mean"), sd.alias("sd"), last.alias("moving_average"))
    return wide.select("slug", "sample", stats.coefficient_of_variation(F.col("sd"), F.col("mean")).alias("volatility"), "moving_average", stats.confidence(F.col("sample")).alias("confidence"))


def top(jobs: DataFrame, bridge: DataFrame, as_of: date, days: tuple[int, ...] = (7, 30, 90), limit: int = 10, direction: str | None = None, window: DataFrame | None = None) -> DataFrame:
    """Headline trend of the most demanded skills of ``window``, in order of demand."""
    demand = sk.counts(jobs if window is None else window, bridge, limit=max(3 * limit, 30)).select("slug", F.col("n").alias("demand"))
    found = headline(windows(jobs, bridge, as_of, days)).join(F.broadcast(demand), "slug")
    if direction is not None:
        found = found.filter(F.col("direction") == direction)
    return found.orderBy(F.desc("demand"), "slug").limit(limit)


def fastest(jobs: DataFrame, bridge: DataFrame, as_of: date, days: int = 30, limit: int = 5, least: int = 5, window: DataFrame | None = None) -> DataFrame:
    """Skills with the largest change over one window, of the most demanded and with enough postings now."""
    demand = sk.counts(jobs if window is None else window, bridge, limit=max(6 * limit, 40)).select("slug")
    found = windows(jobs, bridge, as_of, (days,), least).join(F.broadcast(demand), "slug")
    return found.filter((F.col("current") >= least) & F.col("change").isNotNull()).orderBy(F.desc("change"), "slug").limit(limit)


def emerging(jobs: DataFrame, bridge: DataFrame, as_of: datetime, days: int = 30, limit: int = 10, least: int = 5, most_share: float = 0.01, growth: float = 100.0, z: float = 2.0) -> DataFrame:
    """Skills that grow out of a small baseline, or arrive without one; shares are of mentions.

    The windows without partition hold one row per skill.
    """
    current, baseline = (as_of - timedelta(days=days), as_of), (as_of - timedelta(days=2 * days), as_of - timedelta(days=days))
    every = Window.partitionBy()
    found = sk.windows(jobs, bridge, current, baseline)
    change = stats.percent_change(F.col("current"), F.col("previous"))
    found = found.withColumn("growth", change)
    spread = F.stddev_pop("growth").over(every)
    found = found.select(
        "*",
        F.greatest(F.sum("current").over(every), F.lit(1)).alias("all_current"),
        F.greatest(F.sum("previous").over(every), F.lit(1)).alias("all_previous"),
        F.when(F.count("growth").over(every) >= 2, F.try_divide(F.col("growth") - F.avg("growth").over(every), spread)).alias("z"),
    )
    base = F.col("previous") / F.col("all_previous")
    arrival = F.col("growth").isNull()
    rises = (F.col("growth") >= growth) & (F.col("z").isNull() | (F.col("z") >= z))
    share = F.col("current") / F.col("all_current")
    blend = (
        0.4 * stats.confidence(F.col("current"), 40) + 0.3 * F.least(F.lit(1.0), F.col("growth") / 300.0) + 0.3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("z", F.lit(0.0)) / 4.0))
    ) * F.greatest(F.lit(0.3), F.greatest(F.lit(0.0), 1 - 10 * share))
    confidence = F.when(arrival, 0.8 * stats.confidence(F.col("current"), 30)).otherwise(blend)
    kept = found.filter((F.col("current") >= least) & (base <= most_share) & (arrival | rises))
    return kept.select("slug", "current", "previous", "growth", base.alias("baseline_share"), F.when(~arrival, F.col("z")).alias("z"), F.round(confidence, 4).alias("confidence")).orderBy(F.desc("confidence"), F.desc("current"), "slug").limit(limit)
