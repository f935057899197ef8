"""Co-occurrence of skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import skills as sk


def pairs(jobs: DataFrame, bridge: DataFrame, least: int = 2) -> DataFrame:
    """(skill_a, skill_b, n), a < b: jobs that have both. Pairs are made inside a job's own array, without a self-join.

    A job's skills are bounded by the extractor, so the array is.
    """
    arrays = sk.met(jobs, bridge.select("job_id", "slug")).groupBy("id").agg(F.array_sort(F.collect_set("slug")).alias("s")).filter(F.size("s") > 1)
    left = arrays.select(F.posexplode("s").alias("i", "skill_a"), "s")
    both = left.select("skill_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("skill_b"))
    return both.groupBy("skill_a", "skill_b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def cooccurrence(jobs: DataFrame, bridge: DataFrame, limit: int = 50, least: int = 3, least_support: float = 0.005, skill: str | None = None) -> DataFrame:
    """Support, both confidences, lift and association of pairs; a skill is filtered before the limit."""
    found = pairs(jobs, bridge, least)
    if skill is not None:
        found = found.filter((F.col("skill_a") == skill) | (F.col("skill_b") == skill))
    singles = sk.counts(jobs, bridge)
    total = sk.with_skill(jobs, bridge).withColumnRenamed("n", "total")
    a, b = singles.select(F.col("slug").alias("skill_a"), F.col("n").alias("n_a")), singles.select(F.col("slug").alias("skill_b"), F.col("n").alias("n_b"))
    wide = found.join(a, "skill_a").join(b, "skill_b").join(F.broadcast(total))
    support = F.col("n") / F.col("total")
    lift = support / ((F.col("n_a") / F.col("total")) * (F.col("n_b") / F.col("total")))
    scored = wide.select("skill_a", "skill_b", "n", support.alias("support"), (F.col("n") / F.col("n_a")).alias("confidence_ab"), (F.col("n") / F.col("n_b")).alias("confidence_ba"), lift.alias("lift"), F.round(stats.association(support, lift), 9).alias("association"))
    return scored.filter(F.col("support") >= least_support).orderBy(F.desc("association"), "skill_a", "skill_b").limit(limit)


def related(jobs: DataFrame, bridge: DataFrame, skill: str, limit: int = 10) -> DataFrame:
    found = cooccurrence(jobs, bridge, limit, 2, skill=skill)
    return found.select(F.when(F.col("skill_a") == skill, F.col("skill_b")).otherwise(F.col("skill_a")).alias("slug"), "n", "support", "lift", "association")


def graph(jobs: DataFrame, bridge: DataFrame, limit: int = 40, skills: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (the most demanded skills) and the edges among them."""
    nodes = sk.demand(jobs, bridge, skills, limit)
    known = nodes.select("slug")
    edges = cooccurrence(jobs, bridge, 4 * limit, 2)
    edges = edges.join(F.broadcast(known.withColumnRenamed("slug", "skill_a")), "skill_a", "left_semi").join(F.broadcast(known.withColumnRenamed("slug", "skill_b")), "skill_b", "left_semi")
    return nodes, edges
