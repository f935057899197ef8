"""Demand for skills. A bridge row is (job_id, slug, confidence), unique by job and slug."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.filters import between
from tidemark.functions import stats


def met(jobs: DataFrame, bridge: DataFrame) -> DataFrame:
    return jobs.select("id", "e").join(bridge.withColumnRenamed("job_id", "id"), "id")


def counts(jobs: DataFrame, bridge: DataFrame, skills: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(slug, name, category, n, confidence), most demanded first; ``skills`` (slug, name, category) is a dimension."""
    found = met(jobs, bridge).groupBy("slug").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    if skills is not None:
        found = found.join(skills.select("slug", "name", "category"), "slug", "left")
    else:
        found = found.withColumn("name", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
    found = found.select("slug", F.coalesce("name", "slug").alias("name"), F.coalesce("category", F.lit("other")).alias("category"), "n", "confidence")
    return found if limit is None else found.orderBy(F.desc("n"), "slug").limit(limit)


def with_skill(jobs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(n): jobs with any skill."""
    return jobs.join(bridge.select(F.col("job_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("n"))


def demand(jobs: DataFrame, bridge: DataFrame, skills: DataFrame | None = None, limit: int = 25) -> DataFrame:
    """Ranked demand with each skill's share of the jobs that have any skill. Ranks run over the top rows only."""
    top = counts(jobs, bridge, skills, limit)
    total = with_skill(jobs, bridge).withColumnRenamed("n", "total")
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "slug"))
    return top.join(F.broadcast(total)).select("slug", "name", "category", "n", rank.alias("rank"), stats.share(F.col("n"), F.col("total")).alias("share"), "confidence")


def windows(jobs: DataFrame, bridge: DataFrame, current: tuple[datetime, datetime], baseline: tuple[datetime, datetime]) -> DataFrame:
    """(slug, current, previous): both half-open windows in one pass."""
    seen = met(jobs, bridge).filter(between(*current) | between(*baseline))
    return seen.groupBy("slug").agg(F.count_if(between(*current)).alias("current"), F.count_if(between(*baseline)).alias("previous"))


def daily(jobs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(slug, day, n) of all skills at once."""
    return met(jobs, bridge).groupBy("slug", F.to_date("e").alias("day")).agg(F.count("*").alias("n"))


def all_of(jobs: DataFrame, bridge: DataFrame, slugs: list[str]) -> DataFrame:
    have = bridge.filter(F.col("slug").isin(slugs)).groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("have")).filter(F.col("have") == len(set(slugs)))
    return jobs.join(have, "id", "left_semi")


def any_of(jobs: DataFrame, bridge: DataFrame, slugs: list[str]) -> DataFrame:
    return jobs.join(bridge.filter(F.col("slug").isin(slugs)).select(F.col("job_id").alias("id")), "id", "left_semi")


def similar(jobs: DataFrame, bridge: DataFrame, job_id, limit: int = 5, by_overlap: bool = False) -> DataFrame:
    """Jobs that share any of the first six slugs of one job: newest first, or most shared first."""
    own = bridge.filter(F.col("job_id") == job_id).select("slug").orderBy("slug").limit(6)
    shared = bridge.filter(F.col("job_id") != job_id).join(F.broadcast(own), "slug").groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("shared"))
    order = [F.desc("e"), F.col("id")]
    return jobs.join(shared, "id").orderBy(*([F.desc("shared")] if by_overlap else []), *order).limit(limit)
