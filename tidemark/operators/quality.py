"""Data quality: per-record score, batch dimensions, grade, field quality and events."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import QUALITY_THRESHOLDS, QUALITY_WEIGHTS

# Weights of the fields of a complete posting.
FIELD_WEIGHTS = {"title": 1.5, "description": 1.5, "company": 1.2, "location": 1.0, "published_at": 1.0, "url": 0.8, "employment_type": 0.6, "remote_type": 0.6, "salary": 0.5, "skills": 1.0}


def record_completeness(weights: dict[str, float], has: dict[str, Column]) -> Column:
    parts = [F.when(has[k], w).otherwise(0.0) for k, w in weights.items()]
    return reduce(lambda a, b: a + b, parts) / sum(weights.values())


def completeness(weights: dict[str, float], has: dict[str, Column]) -> Column:
    return F.avg(record_completeness(weights, has))


def record_score(has: dict[str, Column], confidences: list[Column]) -> Column:
    """0.65 completeness and 0.35 mean confidence; unknown confidences are left out of the mean."""
    known = F.filter(F.array(*confidences), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)
    return F.round(0.65 * record_completeness(FIELD_WEIGHTS, has) + 0.35 * mean, 4)


def age_days(at: Column, as_of: datetime) -> Column:
    """Whole elapsed days."""
    return F.floor((F.lit(as_of).cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 86400)


def freshness(at: Column, as_of: datetime, horizon: int = 60) -> Column:
    """Mean of max(0, 1 - age/horizon) over dated rows, times the dated share."""
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - age_days(at, as_of) / float(horizon))
    return F.coalesce(F.avg(fresh) * F.count(at) / F.count("*"), F.lit(0.0))


def problems(as_of: datetime) -> Column:
    """Whether a posting contradicts itself."""
    tests = [
        F.col("salary_min") > F.col("salary_max"), (F.col("salary_provenance") == "observed") & F.col("salary_currency").isNull(),
        F.col("experience_years_min") > F.col("experience_years_max"), F.col("published_at") > F.lit(as_of).cast("timestamp"),
        F.coalesce("normalized_title", F.lit("")).isin("", "Other"),
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def dimensions(jobs: DataFrame, signals: DataFrame, has: dict[str, Column], accuracy: Column, as_of: datetime) -> DataFrame:
    """One row per source of the six dimensions; ``signals`` is (source, received, rejected, duplicates)."""
    base = jobs.groupBy("source").agg(
        completeness(FIELD_WEIGHTS, has).alias("completeness"), (1 - F.avg(problems(as_of).cast("double"))).alias("consistency"),
        F.coalesce(F.avg(accuracy), F.lit(0.0)).alias("accuracy"), freshness(F.col("published_at"), as_of).alias("freshness"),
    )
    ratio = lambda bad: F.when(F.col("received") > 0, F.greatest(F.lit(0.0), 1 - F.col(bad) / F.col("received"))).otherwise(F.lit(1.0))
    return signals.join(base, "source", "left").select("source", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("completeness", "consistency", "accuracy", "freshness")], ratio("rejected").alias("validity"), ratio("duplicates").alias("uniqueness"))


def graded(dims: DataFrame) -> DataFrame:
    """``dims`` with score and grade."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    score = reduce(lambda a, b: a + b, [w * clamp(k) for k, w in QUALITY_WEIGHTS.items()]) / sum(QUALITY_WEIGHTS.values())
    grade = F.when(F.col("score") >= 0.9, "A").when(F.col("score") >= 0.8, "B").when(F.col("score") >= 0.7, "C").when(F.col("score") >= 0.6, "D").otherwise("F")
    return dims.withColumn("score", score).withColumn("grade", grade)


def long(dims: DataFrame) -> DataFrame:
    """(source, dimension, value)."""
    return dims.select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in QUALITY_WEIGHTS])).alias("x")).select("source", "x.*")


def worst(dims: DataFrame, limit: int = 3) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("value", "dimension"))
    return long(dims).withColumn("rank", rank).filter(F.col("rank") <= limit)


def events(dims: DataFrame) -> DataFrame:
    """(source, dimension, value, threshold, severity) where a dimension is under its threshold."""
    limits = F.create_map(*[x for k, v in QUALITY_THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    found = long(dims).withColumn("threshold", F.try_element_at(limits, F.col("dimension"))).filter("value < threshold")
    return found.withColumn("severity", F.when(F.col("value") >= 0.7 * F.col("threshold"), "warning").otherwise("error"))


def fields(jobs: DataFrame, names: list[str]) -> DataFrame:
    """(field, present, missing) in one pass."""
    flat = jobs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("has")) for c in names])).alias("x")).select("x.*")
    return flat.groupBy("field").agg(F.count_if("has").alias("present"), F.count_if(~F.col("has")).alias("missing"))
