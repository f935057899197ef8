"""Bookkeeping of ingestion: cursors of sources, metrics of runs, the audit trail, and the taxonomy's table.

States, runs and events are small tables or appended rows; each function gives the new rows and the caller writes them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.filters import at
from tidemark.operators.maintenance import latest

#: Failures in a row after which a source is paused.
CIRCUIT = 5
COUNTERS = ("records_received", "records_rejected", "jobs_created", "jobs_updated", "duplicates_detected")
STATE = "source string, enabled boolean, last_successful_run_at timestamp, last_attempted_run_at timestamp, last_cursor string, last_timestamp timestamp, records_processed long, records_failed long, consecutive_failures long, etag string"


def advance(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``states`` (columns of STATE) after one run each of some sources.

    ``outcomes`` (source, ok, at, cursor, timestamp, processed, failed, etag) has at most one row a source. A run that
    succeeded moves what it names: null cursors and tags keep the old ones, the timestamp never goes back. One that
    failed only counts. Sources seen for the first time start enabled.
    """
    o = outcomes.select("source", *[F.col(c).alias(f"_{c}") for c in ("ok", "at", "cursor", "timestamp", "processed", "failed", "etag")])
    ok, ran = F.coalesce("_ok", F.lit(False)), F.col("_at").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    add = lambda c, more: zero(c) + F.when(ok, zero(more)).otherwise(0)
    moved = {
        "source": F.col("source"),
        "enabled": F.coalesce("enabled", F.lit(True)),
        "last_successful_run_at": F.when(ok, F.col("_at")).otherwise(F.col("last_successful_run_at")),
        "last_attempted_run_at": F.coalesce("_at", "last_attempted_run_at"),
        "last_cursor": F.when(ok, F.coalesce("_cursor", "last_cursor")).otherwise(F.col("last_cursor")),
        "last_timestamp": F.when(ok, F.greatest("_timestamp", "last_timestamp")).otherwise(F.col("last_timestamp")),
        "records_processed": add("records_processed", "_processed"),
        "records_failed": add("records_failed", "_failed"),
        "consecutive_failures": F.when(ok, 0).otherwise(zero("consecutive_failures") + ran.cast("long")).cast("long"),
        "etag": F.when(ok, F.coalesce("_etag", "etag")).otherwise(F.col("etag")),
    }
    return states.join(o, "source", "full").select(*[c.alias(n) for n, c in moved.items()])


def circuit_open(threshold: int = CIRCUIT) -> Column:
    return F.col("consecutive_failures") >= threshold


def due(states: DataFrame, threshold: int = CIRCUIT) -> DataFrame:
    """Sources that a run may ask: enabled and not paused."""
    return states.filter(F.col("enabled") & ~circuit_open(threshold))


def with_rates(runs: DataFrame, now: datetime) -> DataFrame:
    """``runs`` with duration_seconds (up to ``now`` while open) and throughput_per_second, 0 for no duration."""
    end = F.coalesce("finished_at", at(now))
    seconds = F.greatest(end.cast("double") - F.col("started_at").cast("double"), F.lit(0.0))
    rate = F.when(F.col("duration_seconds") > 0, F.col("records_received") / F.col("duration_seconds")).otherwise(0.0)
    return runs.withColumn("duration_seconds", seconds).withColumn("throughput_per_second", rate)


def save(runs: DataFrame, written: DataFrame) -> DataFrame:
    """Runs by id, a later write in place of an earlier one; open runs have no end yet, so ends come last."""
    both = runs.withColumn("_w", F.lit(0)).unionByName(written.withColumn("_w", F.lit(1)))
    return latest(both, ["id"], ["_w", "finished_at"]).drop("_w")


def recent(runs: DataFrame, source: str | None = None, limit: int = 20) -> DataFrame:
    found = runs if source is None else runs.filter(F.col("source") == source)
    return found.orderBy(F.desc("started_at"), "id").limit(limit)


def last_successful(runs: DataFrame) -> DataFrame:
    """The newest run of each source that succeeded."""
    return latest(runs.filter("status = 'success'"), ["source"], ["started_at", "id"])


def summary(runs: DataFrame, since: datetime) -> DataFrame:
    """One row: number of runs, sums of the counters and the average quality of runs since then; 0 where there are none."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in COUNTERS]
    return runs.filter(F.col("started_at") >= at(since)).agg(F.count("*").cast("double").alias("runs"), *sums, F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("average_quality"))


def counts_since(rows: DataFrame, column: str, when: str, since: datetime) -> DataFrame:
    """(``column``, n) of rows since then: rejections by reason, quality events by dimension or source."""
    return rows.filter(F.col(when) >= at(since)).groupBy(column).agg(F.count("*").alias("n"))


def audit(created: DataFrame, duplicates: DataFrame, run_id: str, now: datetime) -> DataFrame:
    """(job_id, event_type, occurred_at, source, run_id, payload): one event a posting of a batch.

    ``created`` is (id, source, status, quality_score), ``duplicates`` (id, source, duplicate_of, kind, similarity).
    """
    text = lambda c: F.col(c).cast("string")

    def events(rows: DataFrame, kind: str, payload: dict[str, str]) -> DataFrame:
        held = F.create_map(*[x for name, c in payload.items() for x in (F.lit(name), text(c))])
        return rows.select(text("id").alias("job_id"), F.lit(kind).alias("event_type"), at(now).alias("occurred_at"), "source", F.lit(run_id).alias("run_id"), held.alias("payload"))

    return events(created, "job.created", {"status": "status", "quality": "quality_score"}).unionByName(
        events(duplicates, "job.duplicate", {"duplicate_of": "duplicate_of", "kind": "kind", "similarity": "similarity"})
    )


def sync_taxonomy(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """The dimension (slug, name, category, aliases, parent_slug) with ``nodes`` (slug, name, category, aliases, parent) in it.

    Nodes replace rows of their slug, others stay. A parent that neither table has is left null. Slugs are unique in both.
    """
    n = nodes.select("slug", F.coalesce("name", "slug").alias("name"), F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("parent").alias("parent_slug"))
    both = n.unionByName(known.join(nodes.select("slug"), "slug", "left_anti").select(n.columns))
    there = both.select(F.col("slug").alias("parent_slug"), F.lit(True).alias("_there"))
    return both.join(there, "parent_slug", "left").withColumn("parent_slug", F.when(F.col("_there"), F.col("parent_slug"))).select(n.columns)


def replace_job_skills(bridge: DataFrame, batch: DataFrame, links: DataFrame) -> DataFrame:
    """The bridge after a batch: links of the postings of ``batch`` (id) go, ``links`` come in."""
    return bridge.join(batch.select(F.col("id").alias("job_id")), "job_id", "left_anti").select(bridge.columns).unionByName(links.select(bridge.columns))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(F.col("read_at").isNull()).alias("n"))


def latest_day(snapshots: DataFrame, column: str = "day") -> DataFrame:
    return snapshots.agg(F.max(column).alias(column))


def partition_day() -> Column:
    """The day that the partition columns year, month and day name; null for impossible ones."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.col("year"), F.col("month"), F.col("day")), F.lit("yyyy-MM-dd")).cast("date")


def averages(jobs: DataFrame) -> DataFrame:
    """One row: average least years of experience (null if none is known) and average quality, null as 0."""
    return jobs.agg(F.avg("experience_years_min").alias("experience_years"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("quality_score"))


def mark_triggered(rules: DataFrame, sent: DataFrame, now: datetime) -> DataFrame:
    """``rules`` with last_triggered_at moved for those that ``sent`` (rule_id) notified."""
    hit = sent.select("rule_id").distinct().withColumn("_hit", F.lit(True))
    return rules.join(hit, "rule_id", "left").withColumn("last_triggered_at", F.when(F.col("_hit"), at(now)).otherwise(F.col("last_triggered_at"))).select(rules.columns)
