"""Distributions over one dimension, their changes, facets and coverage."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.filters import at
from tidemark.functions import stats


def one(jobs: DataFrame, dimension: str) -> DataFrame:
    return jobs.groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n"))


def many(jobs: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) of several dimensions in one pass, by grouping sets."""
    flat = jobs.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")).select("x.*")
    return flat.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def facets(jobs: DataFrame, dimensions: list[str], bridge: DataFrame | None = None, top: int = 25, top_skills: int = 30) -> DataFrame:
    """(dimension, value, n, rank): the most frequent non-null values of each dimension, and skills."""
    found = many(jobs, dimensions).filter("value is not null")
    if bridge is not None:
        skills = jobs.select("id").join(bridge.select(F.col("job_id").alias("id"), "slug"), "id").groupBy(F.col("slug").alias("value")).agg(F.count("*").alias("n"))
        found = found.unionByName(skills.select(F.lit("skill").alias("dimension"), "value", "n"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("dimension") == "skill", top_skills).otherwise(top))


def zero_filled(jobs: DataFrame, dimension: str, vocabulary: list[str]) -> DataFrame:
    """(value, n, share) with a row for each word of the vocabulary."""
    words = jobs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in vocabulary])).alias("value"))
    full = words.join(one(jobs, dimension), "value", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("share", stats.share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def share_change(jobs: DataFrame, flag: Column, as_of: datetime, days: int) -> DataFrame:
    """(current_share, previous_share, change) of a flag over two closed windows that share their border."""
    middle, first = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    now, before = (F.col("e") >= at(middle)) & (F.col("e") <= at(as_of)), (F.col("e") >= at(first)) & (F.col("e") <= at(middle))
    one = jobs.agg(F.count_if(now & flag).alias("a"), F.count_if(now).alias("b"), F.count_if(before & flag).alias("c"), F.count_if(before).alias("d"))
    current, previous = F.try_divide("a", "b"), F.try_divide("c", "d")
    return one.select(current.alias("current_share"), previous.alias("previous_share"), stats.percent_change(current, previous).alias("change"))


def coverage(jobs: DataFrame, *dimensions: str) -> DataFrame:
    """Exact distinct counts; see ``approximate_coverage`` for the sketch."""
    return jobs.agg(*[F.count_distinct(d).alias(d) for d in dimensions])


def approximate_coverage(jobs: DataFrame, *dimensions: str, rsd: float = 0.02) -> DataFrame:
    return jobs.agg(*[F.approx_count_distinct(d, rsd).alias(d) for d in dimensions])
