"""A deterministic corpus of postings with known trends, made by expressions of a row number."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Demand of a skill at the start and the end of the period.
DEMAND = (("FastAPI", 0.35, 1.60), ("Python", 0.85, 1.25), ("Kubernetes", 0.60, 1.45), ("Rust", 0.30, 1.20), ("Polars", 0.15, 1.10), ("dbt", 0.40, 1.30), ("COBOL", 1.40, 0.35), ("Mainframe", 1.35, 0.40), ("VB.NET", 1.30, 0.30), ("Jenkins", 1.20, 0.70))
PLACES = ("Berlin, Germany", "Austin, TX", "London, United Kingdom", "Paris, France", "Remote", "Bengaluru, India")
ROLES = ("Backend Engineer", "Data Engineer", "Frontend Engineer", "DevOps Engineer", "QA Engineer")


def postings(spark: SparkSession, count: int, as_of: datetime, days: int = 120, seed: int = 7, duplicates: float = 0.06, malformed: float = 0.02, salaries: float = 0.55) -> DataFrame:
    """``count`` raw records over ``days``; a share are reposts under a new source, a share lack a title."""
    u = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("k")), F.lit(1 << 30)) / float(1 << 30)
    base = spark.range(count).withColumn("n", F.col("id"))
    repost = F.pmod(F.xxhash64(F.lit(seed), F.lit("repost"), F.col("id")), F.lit(1 << 30)) / float(1 << 30) < duplicates
    rows = base.withColumn("repost", repost & (F.col("id") > 0)).withColumn("k", F.when(F.col("repost"), F.col("id") - 1).otherwise(F.col("id")))
    rows = rows.withColumn("share", u("day")).withColumn("published_at", (F.lit(as_of - timedelta(days=days)).cast("timestamp").cast("double") + F.col("share") * days * 86400).cast("timestamp"))
    pick = lambda words, name: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(u(name) * len(words)) + 1).cast("int"))
    chosen = [F.when(u("skill " + s) < 0.4 * (a + (b - a) * F.col("share")), s) for s, a, b in DEMAND]
    level = pick(("Senior ", "Junior ", "", "Lead "), "level")
    pay = F.concat(F.format_number(40000 + F.floor(u("pay") * 40) * 1000, 0), F.lit(" - "), F.format_number(90000 + F.floor(u("pay") * 40) * 1000, 0), F.lit(" EUR per year"))
    return rows.select(
        F.when(F.col("repost"), "mirror").otherwise("synthetic").alias("source"), F.lit("synthetic").alias("source_kind"), F.concat(F.lit("job-"), F.col("n")).alias("source_job_id"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("k"), F.lit("?utm_source="), F.col("n")).alias("url"), F.when(u("bad") >= malformed, F.concat(level, pick(ROLES, "role"))).alias("title"),
        F.concat(F.lit("We are hiring for the team.\nRequirements\n"), F.array_join(F.array_compact(F.array(*chosen)), ", "), F.lit("\n3+ years of experience. Reference "), F.col("k")).alias("description"),
        F.concat(F.lit("Company "), F.floor(u("company") * 40), F.lit(" GmbH")).alias("company"), pick(PLACES, "place").alias("location"), F.when(u("told") < salaries, pay).alias("salary"),
        pick(("Full-time", "Contract", "Part-time"), "kind").alias("employment_type"), pick(("remote", "hybrid", "onsite"), "remote").alias("remote_status"), F.lit("Software").alias("industry"), "published_at",
    )
