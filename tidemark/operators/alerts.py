"""Threshold alerts: a long table of readings, rules joined to it, notifications by channel."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.filters import compare, live
from tidemark.operators import salary

ZERO_IF_ABSENT = ("skill_job_count", "company_job_count", "emerging_skill")


def readings(everything: DataFrame, jobs: DataFrame, bridge: DataFrame, remote: Column, trends: DataFrame | None = None, emerging: DataFrame | None = None) -> DataFrame:
    """(metric, subject, value) of every metric; ``trends`` (slug, change) and ``emerging`` (slug, confidence) are optional."""
    row = lambda df, metric: df.select(F.lit(metric).alias("metric"), F.col("subject").cast("string").alias("subject"), F.col("value").cast("double").alias("value"))
    skill = jobs.select("id").join(bridge.select(F.col("job_id").alias("id"), "slug"), "id").groupBy(F.col("slug").alias("subject")).agg(F.count("*").alias("value"))
    company = jobs.groupBy(F.lower("company_name").alias("subject")).agg(F.count("*").alias("value"))
    one = jobs.agg(F.avg(F.when(salary.observed(), F.col("salary_mid"))).alias("pay"), (100.0 * F.try_divide(F.count_if(remote), F.count("*"))).alias("remote"))
    parts = [
        row(skill, "skill_job_count"), row(company, "company_job_count"),
        row(one.select(F.lit("").alias("subject"), F.col("pay").alias("value")), "average_salary"),
        row(one.select(F.lit("").alias("subject"), F.col("remote").alias("value")), "remote_share_pct"),
        row(everything.agg(F.count_if(live()).alias("value")).withColumn("subject", F.lit("")), "total_active_jobs"),
    ]
    if trends is not None:
        parts.append(row(trends.select(F.col("slug").alias("subject"), F.col("change").alias("value")), "skill_demand_change_pct"))
    if emerging is not None:
        parts.append(row(emerging.select(F.col("slug").alias("subject"), F.col("confidence").alias("value")), "emerging_skill"))
        parts.append(row(emerging.agg(F.count("*").alias("value")).withColumn("subject", F.lit("")), "emerging_skill"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(rules: DataFrame, found: DataFrame, as_of: datetime) -> DataFrame:
    """Rules with value, triggered and suppressed (within the cooldown); disabled rules are left out."""
    subject = F.when(F.col("metric") == "company_job_count", F.lower("subject")).otherwise(F.coalesce("subject", F.lit("")))
    r = rules.filter("enabled").withColumn("_s", subject)
    joined = r.join(found.select(F.col("metric").alias("_m"), F.col("subject").alias("_t"), "value"), (F.col("metric") == F.col("_m")) & (F.col("_s") == F.col("_t")), "left").drop("_m", "_t", "_s")
    value = F.when(F.col("metric").isin(*ZERO_IF_ABSENT), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    joined = joined.withColumn("value", value)
    resting = F.lit(as_of).cast("timestamp") < F.col("last_triggered_at") + F.make_dt_interval(mins=F.col("cooldown_minutes"))
    met = F.coalesce(compare(F.col("value"), F.col("operator"), F.col("threshold")), F.lit(False))
    cooling = F.coalesce(resting, F.lit(False))
    return joined.withColumn("triggered", met & ~cooling).withColumn("suppressed", met & cooling)


def notifications(evaluated: DataFrame, limit: int = 100) -> DataFrame:
    """One row per channel of each triggered rule, ``limit`` a run."""
    return evaluated.filter("triggered").select("rule_id", F.explode("channels").alias("channel"), "metric", "subject", "value", "threshold").orderBy("rule_id", "channel").limit(limit)
