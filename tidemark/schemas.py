"""Declared schemas and vocabularies; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIVE = ("active", "updated")

# Fixed values of the data model: vocabularies in the order in which they rank.
REMOTE = ("remote", "hybrid", "onsite", "unknown")
EMPLOYMENT = ("full_time", "part_time", "contract", "internship", "temporary", "freelance", "volunteer", "unknown")
LEVELS = ("intern", "entry", "junior", "mid", "senior", "lead", "principal", "manager", "director", "executive", "unknown")
PERIOD_FACTOR = {"hourly": 2080.0, "daily": 260.0, "weekly": 52.0, "monthly": 12.0, "yearly": 1.0}
QUALITY_WEIGHTS = {"completeness": 0.25, "validity": 0.20, "uniqueness": 0.15, "consistency": 0.15, "accuracy": 0.15, "freshness": 0.10}
QUALITY_THRESHOLDS = {"completeness": 0.6, "validity": 0.9, "uniqueness": 0.7, "consistency": 0.8, "accuracy": 0.5, "freshness": 0.5}

RAW = T.StructType(
    [T.StructField(c, T.StringType(), c not in ("source", "source_job_id")) for c in (
        "source", "source_kind", "source_job_id", "url", "title", "description", "company", "location", "salary", "employment_type", "remote_status", "industry")]
    + [T.StructField("published_at", T.TimestampType()), T.StructField("collected_at", T.TimestampType()),
       T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)

SKILL = T.StructType([
    T.StructField("slug", T.StringType()), T.StructField("name", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("occurrences", T.IntegerType()),
    T.StructField("field", T.StringType()), T.StructField("is_required", T.BooleanType()),
])

_STRINGS = ("id", "source", "source_job_id", "title", "normalized_title", "title_family", "specialization", "company_name", "company_slug", "industry", "segment", "country_code", "country", "region", "city", "remote_type", "employment_type", "experience_level")
#: The 37 columns of the columnar store.
EXPORT = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField(c, T.DoubleType()) for c in ("experience_years_min", "experience_years_max", "salary_min", "salary_max")]
    + [T.StructField(c, T.StringType()) for c in ("salary_currency", "salary_period", "salary_provenance")]
    + [T.StructField(c, T.DoubleType()) for c in ("salary_annual_min", "salary_annual_max")]
    + [T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("skill_count", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("quality_score", T.DoubleType()), T.StructField("status", T.StringType())]
    + [T.StructField("published_at", T.TimestampType()), T.StructField("first_seen_at", T.TimestampType())]
    + [T.StructField(c, T.IntegerType()) for c in ("year", "month", "day")]
)

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("occurred_at", T.TimestampType()),
    T.StructField("job_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order, cast; absent ones are null, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
