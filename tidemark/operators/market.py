"""Geography, companies, segments, market overview and profile fit."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.filters import at, between, live
from tidemark.functions import stats
from tidemark.operators import quantiles, salary, skills as sk


def places(jobs: DataFrame, keys: list[str], remote: Column, limit: int = 25) -> DataFrame:
    """(keys, n, remote_share, share of the returned rows, share_of_total); places without the first key are left out."""
    found = jobs.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(remote).alias("remote"))
    total = found.agg(F.sum("n").alias("total"))
    top = found.orderBy(F.desc("n"), *keys).limit(limit).join(F.broadcast(total))
    return top.select(*keys, "n", stats.share(F.col("remote"), F.col("n")).alias("remote_share"), stats.share(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share"), stats.share(F.col("n"), F.col("total")).alias("share_of_total"))


def hiring(all_live: DataFrame, jobs: DataFrame, remote: Column, as_of: datetime, days: int, limit: int = 20) -> DataFrame:
    """Top companies of ``jobs`` with growth between two half-open windows of all live postings."""
    top = jobs.groupBy("company_name").agg(F.count("*").alias("n"), F.count_if(remote).alias("remote")).orderBy(F.desc("n"), "company_name").limit(limit)
    now, before = (as_of - timedelta(days=days), as_of), (as_of - timedelta(days=2 * days), as_of - timedelta(days=days))
    # the top rows are at most `limit`: a proven bound
    moved = all_live.join(F.broadcast(top.select("company_name")), "company_name", "left_semi").groupBy("company_name").agg(F.count_if(between(*now)).alias("current"), F.count_if(between(*before)).alias("previous"))
    wide = top.join(moved, "company_name", "left")
    return wide.select("company_name", "n", F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("previous", F.lit(0)).alias("previous"), stats.percent_change(F.col("current"), F.col("previous")).alias("growth"), stats.share(F.col("remote"), F.col("n")).alias("remote_share"))


def growth_map(all_live: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """(company_name, current, previous) of every company in either window."""
    now, before = (as_of - timedelta(days=days), as_of), (as_of - timedelta(days=2 * days), as_of - timedelta(days=days))
    return all_live.filter(between(*now) | between(*before)).groupBy("company_name").agg(F.count_if(between(*now)).alias("current"), F.count_if(between(*before)).alias("previous"))


def company_skills(jobs: DataFrame, bridge: DataFrame, limit: int = 10, company: str | None = None) -> DataFrame:
    """Top skills of each company (or of one), with the share of the company's largest count."""
    found = jobs if company is None else jobs.filter(F.col("company_name") == company)
    n = found.select("id", "company_name").join(bridge.select(F.col("job_id").alias("id"), "slug"), "id").groupBy("company_name", "slug").agg(F.count("*").alias("n"))
    own = Window.partitionBy("company_name")
    ranked = n.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "slug"))).filter(F.col("rank") <= limit)
    return ranked.withColumn("share", stats.share(F.col("n"), F.max("n").over(own)))


def counters(jobs: DataFrame) -> DataFrame:
    """(company_name, active, total)."""
    return jobs.groupBy("company_name").agg(F.count_if(live()).alias("active"), F.count("*").alias("total"))


def segments(all_live: DataFrame, jobs: DataFrame, bridge: DataFrame, remote: Column, as_of: datetime, days: int, limit: int = 15, top: int = 5, least: int = 5) -> DataFrame:
    """Per segment: count, share, remote share, median salary, growth over closed windows, top skills."""
    base = jobs.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(remote).alias("remote"), F.count(F.when(salary.observed(), F.lit(1))).alias("samples"))
    median = quantiles.exact(jobs.filter(salary.observed()), ["segment"], F.col("salary_mid"), [0.5]).select(F.col("segment").alias("_segment"), F.col("q")[0].alias("median"))
    base = base.join(median, F.col("segment").eqNullSafe(F.col("_segment")), "left").drop("_segment")
    base = base.withColumn("share", stats.share(F.col("n"), F.sum("n").over(Window.partitionBy())))
    middle, first = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    moved = all_live.groupBy("segment").agg(F.count_if((F.col("e") >= at(middle)) & (F.col("e") <= at(as_of))).alias("a"), F.count_if((F.col("e") >= at(first)) & (F.col("e") <= at(middle))).alias("b"))
    n = jobs.select("id", "segment").join(bridge.select(F.col("job_id").alias("id"), "slug"), "id").groupBy("segment", "slug").agg(F.count("*").alias("k"))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("k"), "slug"))).filter(F.col("r") <= top)
    listed = ranked.groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "slug"))), lambda x: x["slug"]), ",").alias("top_skills"))
    wide = base.join(moved, "segment", "left").join(listed, "segment", "left")
    return wide.select("segment", "n", "share", stats.share(F.col("remote"), F.col("n")).alias("remote_share"), F.when(F.col("samples") >= least, F.col("median")).alias("median_salary"), stats.percent_change(F.col("a"), F.col("b")).alias("growth"), "top_skills").orderBy(F.desc("n"), "segment").limit(limit)


def overview(everything: DataFrame, jobs: DataFrame, remote: Column, as_of: datetime) -> DataFrame:
    """The headline row: global counts ignore the filter, the rest obeys it."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    whole = everything.agg(F.count_if(live()).alias("active_jobs"), F.count("*").alias("total_jobs"), F.count_if(F.col("first_seen_at") >= at(day)).alias("new_today"), F.count_if(F.col("first_seen_at") >= at(as_of - timedelta(days=7))).alias("new_week"), F.greatest(F.lit(0.0), (F.lit(as_of).cast("timestamp").cast("double") - F.max(F.col("first_seen_at")).cast("double")) / 3600).alias("freshness_hours"))
    scoped = jobs.agg(F.count_distinct("company_name").alias("companies"), F.count_distinct("country").alias("countries"), stats.share(F.count_if(remote), F.count("*")).alias("remote_share"), F.count(F.when(salary.observed(), F.lit(1))).alias("samples"))
    median = quantiles.exact(jobs.filter(salary.observed()), [], F.col("salary_mid"), [0.5]).select(F.col("q")[0].alias("median_salary"))
    return whole.join(F.broadcast(scoped)).join(F.broadcast(median), F.lit(True), "left")  # one row each


def fit(jobs: DataFrame, bridge: DataFrame, owned: list[str], matching: int, limit: int = 30) -> DataFrame:
    """(coverage, score) of a profile: how much of the demand for the top skills its own skills cover."""
    top = sk.counts(jobs, bridge, limit=limit)
    mine = F.col("slug").isin(owned) if owned else F.lit(False)
    one = top.agg(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    coverage = stats.share(F.col("covered"), F.col("whole"))
    score = 0.6 * coverage + 0.25 * F.least(F.lit(1.0), F.lit(matching) / 50.0) + 0.15 * F.least(F.lit(1.0), F.lit(len(set(owned))) / 12.0)
    return one.select(coverage.alias("coverage"), F.when(F.lit(bool(owned)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).otherwise(F.lit(0.0)).alias("score"))


def missing(jobs: DataFrame, bridge: DataFrame, owned: list[str], limit: int = 30, most: int = 10) -> DataFrame:
    """(slug, n, rank): the first skills in demand that the profile lacks."""
    ranked = sk.demand(jobs, bridge, limit=limit)
    return ranked.filter(~F.col("slug").isin(owned)).orderBy("rank").limit(most).select("slug", "n", "rank", "share")
