"""Salary statistics, aggregated in place; quantiles by rank selection, so that no task holds a group; small samples are suppressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import quantiles

QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
DIMENSIONS = ("experience_level", "segment", "country_code", "remote_type", "employment_type", "company_name", "city")


def observed() -> Column:
    return (F.col("salary_provenance") == "observed") & (F.col("salary_mid") > 0)


def _sums(least: int) -> list[Column]:
    n = F.count("salary_mid")
    return [n.alias("sample_size"), *[F.when(n >= least, f("salary_mid")).alias(name) for name, f in (("average", F.avg), ("low", F.min), ("high", F.max))]]


def _named(least: int) -> list[Column]:
    """The columns of sums and an array ``q`` of quantiles, in order."""
    known = [F.when(F.col("sample_size") >= least, F.col("q")[i]).alias(name) for i, name in enumerate(QUANTILES)]
    return ["sample_size", "average", *known, "low", "high"]


def overview(jobs: DataFrame, least: int = 5) -> DataFrame:
    seen = jobs.select(F.when(observed(), F.col("salary_mid")).alias("salary_mid"), F.when(observed(), 1.0).otherwise(0.0).alias("seen"))
    sums = seen.agg(*_sums(least), F.coalesce(F.avg("seen"), F.lit(0.0)).alias("observed_share"))
    q = quantiles.exact(jobs.filter(observed()), [], F.col("salary_mid"), list(QUANTILES.values()))
    return sums.join(F.broadcast(q), F.lit(True), "left").select(*_named(least), "observed_share")  # one row each


def by(jobs: DataFrame, dimension: str, least: int = 5, limit: int = 20) -> DataFrame:
    """Statistics of each value with a known dimension and a large enough sample, best paid first."""
    known = jobs.filter(observed() & F.col(dimension).isNotNull()).select(F.col(dimension).alias("value"), "salary_mid")
    found = known.groupBy("value").agg(*_sums(least)).filter(F.col("sample_size") >= least)
    q = quantiles.exact(known, ["value"], F.col("salary_mid"), list(QUANTILES.values()))
    return found.join(q.drop("n"), "value").select("value", *_named(least)).orderBy(F.desc_nulls_last("median"), "value").limit(limit)


def for_skill(jobs: DataFrame, bridge: DataFrame, slug: str, least: int = 5) -> DataFrame:
    return overview(jobs.join(bridge.filter(F.col("slug") == slug).select(F.col("job_id").alias("id")), "id", "left_semi"), least).drop("observed_share")


def median_by_segment(jobs: DataFrame, least: int = 5) -> DataFrame:
    """(segment, n, median) of the columnar store: the mean of both bounds, the lower one where there is no upper."""
    mid = (F.col("salary_annual_min") + F.coalesce("salary_annual_max", "salary_annual_min")) / 2
    known = jobs.filter((F.col("salary_provenance") == "observed") & F.col("salary_annual_min").isNotNull())
    found = quantiles.exact(known, ["segment"], mid, [0.5]).select("segment", "n", F.col("q")[0].alias("median"))
    return found.filter(F.col("n") >= least).orderBy(F.desc("median"), "segment")


def midpoint() -> Column:
    return stats.midpoint(F.col("salary_annual_min"), F.col("salary_annual_max"))
