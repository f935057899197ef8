"""Keyed maintenance of stored tables: upserts, expiry, dimensions, facts, latest rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.filters import at
from tidemark.schemas import LIVE


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by natural key: unseen rows come in, seen ones take new values but keep first_seen_at and id.

    Status of a seen row: expired becomes active, changed content becomes updated, else it stays.
    ``new`` is unique by key. Columns are those of ``old``.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    was, came = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()
    status = (
        F.when(~came, F.col("o.status")).when(~was, F.lit("active")).when(F.col("o.status") == "expired", "active")
        .when(~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")), "updated").otherwise(F.col("o.status"))
    )

    def column(c: str) -> Column:
        if c == "status":
            return status.alias(c)
        if c in (*keys, "id", "first_seen_at"):
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return (F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c)

    return joined.select(*[column(c) for c in old.columns])


def expire(jobs: DataFrame, cutoff: datetime, source: str | None = None) -> DataFrame:
    stale = F.col("status").isin(*LIVE) & (F.col("last_seen_at") < at(cutoff))
    if source is not None:
        stale = stale & (F.col("source") == source)
    return jobs.withColumn("status", F.when(stale, "expired").otherwise(F.col("status")))


def mark_duplicates(jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` is (id, duplicate_of, kind)."""
    v = verdicts.select("id", F.col("duplicate_of").alias("_d"))
    return jobs.join(v, "id", "left").withColumn("duplicate_of", F.coalesce("_d", "duplicate_of")).drop("_d")


def touch(jobs: DataFrame, ids: DataFrame, seen_at: datetime) -> DataFrame:
    """Move last_seen_at of the given ids; expired ones become active again."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = jobs.join(hit, "id", "left")
    status = F.when(F.col("_hit") & (F.col("status") == "expired"), "active").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("last_seen_at", F.when(F.col("_hit"), at(seen_at)).otherwise(F.col("last_seen_at"))).drop("_hit")


def delete_source(jobs: DataFrame, source: str) -> DataFrame:
    return jobs.filter(~F.col("source").eqNullSafe(source))


def prune(rows: DataFrame, column: str, as_of: datetime, keep_days: int = 90) -> DataFrame:
    return rows.filter(F.col(column) >= at(as_of) - F.make_dt_interval(days=F.lit(keep_days)))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; last write wins on ties of a full order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], written: str) -> DataFrame:
    """Daily tables (skill, day) or (day): union, then the last computed row."""
    return latest(old.unionByName(new), keys, [written])


def new_keys(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def resolve(known: DataFrame, rows: DataFrame, slug: Column, name: Column) -> DataFrame:
    """A dimension (slug, name) with what ``rows`` add, first name in order kept."""
    found = rows.select(slug.alias("slug"), name.alias("name")).filter("slug is not null").groupBy("slug").agg(F.min("name").alias("name"))
    return known.unionByName(found.join(known.select("slug"), "slug", "left_anti"))


def enrich(dimension: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill nulls only."""
    f = facts.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    joined = dimension.join(f, key, "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in dimension.columns])


def salary_facts(jobs: DataFrame, base: str | None = "USD") -> DataFrame:
    """Observed salaries with a midpoint, in the base currency only unless ``base`` is None."""
    mid = F.coalesce("salary_mid", (F.coalesce("salary_annual_min", "salary_annual_max") + F.coalesce("salary_annual_max", "salary_annual_min")) / 2)
    found = jobs.filter((F.col("salary_provenance") == "observed") & mid.isNotNull() & F.col("salary_currency").isNotNull())
    if base is not None:
        found = found.filter(F.col("salary_currency") == base)
    return found.select(F.col("id").alias("job_id"), mid.alias("annual_midpoint"), "segment", "experience_level", "country_code", F.col("e").alias("observed_at"))


def job_skills(jobs: DataFrame) -> DataFrame:
    """The bridge of an array of skill structs; the first occurrence of a slug wins."""
    flat = jobs.select(F.col("id").alias("job_id"), F.posexplode("skills").alias("pos", "s"))
    first = flat.groupBy("job_id", F.col("s.slug").alias("slug")).agg(F.min_by("s", "pos").alias("s"))
    return first.select("job_id", "slug", *[F.col(f"s.{c}").alias(c) for c in ("confidence", "occurrences", "field", "is_required")])
