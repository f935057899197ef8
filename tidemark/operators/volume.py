"""Posting volume over days and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats


def daily(jobs: DataFrame) -> DataFrame:
    """(day, n)."""
    return jobs.groupBy(F.to_date("e").alias("day")).agg(F.count("*").alias("n"))


def dense(jobs: DataFrame, start: str, end: str, width: int = 7) -> DataFrame:
    """(day, n, ma, total, mean): a row for every day. The windows run over one row per calendar day."""
    days = stats.dense_days(daily(jobs), start, end)
    every = Window.partitionBy()
    return days.select(
        "day", "n", stats.moving_average(F.col("n"), Window.orderBy("day"), width).alias("ma"), F.sum("n").over(every).alias("total"), F.avg("n").over(every).alias("mean")
    )


def monthly_matrix(jobs: DataFrame, bridge: DataFrame, skills: list[str], months: int = 12) -> DataFrame:
    """(year, month, slug, n), newest month first, at most months x skills rows."""
    wanted = bridge.filter(F.col("slug").isin(skills)).select(F.col("job_id").alias("id"), "slug")
    met = jobs.select("id", F.year("e").alias("year"), F.month("e").alias("month")).join(wanted, "id")
    return met.groupBy("year", "month", "slug").agg(F.count("*").alias("n")).orderBy(F.desc("year"), F.desc("month"), F.desc("n"), "slug").limit(months * len(skills))


def describe(jobs: DataFrame) -> DataFrame:
    """(rows, first_day, last_day)."""
    return jobs.agg(F.count("*").alias("rows"), F.to_date(F.min("e")).alias("first_day"), F.to_date(F.max("e")).alias("last_day"))
