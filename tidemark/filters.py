"""The shared predicates and the analytics filter, as Columns.

Time is always an argument. Filter windows are closed on both ends, comparison windows are half-open.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import LIVE


def live() -> Column:
    """A posting counts if it is live and not a duplicate."""
    return F.col("status").isin(*LIVE) & F.col("duplicate_of").isNull()


def event_time() -> Column:
    return F.coalesce("published_at", "first_seen_at")


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp")


@dataclass(frozen=True)
class AnalyticsFilter:
    """Optional predicates of an analytical question; bounds are those of the service it serves."""

    as_of: datetime
    window_days: int = 30
    date_from: datetime | None = None
    date_to: datetime | None = None
    country_code: str | None = None
    city: str | None = None
    company: str | None = None
    segment: str | None = None
    seniority: str | None = None
    remote_type: str | None = None
    skill: str | None = None
    source: str | None = None
    limit: int = 25

    def __post_init__(self) -> None:
        if not 1 <= self.window_days <= 1825 or not 1 <= self.limit <= 500:
            raise ValueError("window_days is 1 to 1825, limit is 1 to 500")

    @property
    def start(self) -> datetime:
        return self.date_from or self.as_of - timedelta(days=self.window_days)

    def with_window(self, days: int) -> AnalyticsFilter:
        return replace(self, window_days=days)

    def cache_key(self) -> str:
        parts = {k: v for k, v in sorted(self.__dict__.items()) if v is not None}
        return ":".join(f"{k}={v}" for k, v in parts.items())

    def window(self) -> Column:
        """Closed window; literals are computed here, so the scan gets them."""
        found = F.col("e") >= at(self.start)
        return found if self.date_to is None else found & (F.col("e") <= at(self.date_to))

    def predicates(self) -> Column:
        equal = {"segment": self.segment, "experience_level": self.seniority, "remote_type": self.remote_type, "source": self.source, "company_slug": self.company}
        found = [F.col(c) == v for c, v in equal.items() if v is not None]
        if self.country_code is not None:
            found.append(F.col("country_code") == self.country_code.upper())
        if self.city is not None:
            found.append(F.lower("city") == self.city.lower())
        return reduce(lambda a, b: a & b, found, F.lit(True))

    def apply(self, jobs: DataFrame, bridge: DataFrame | None = None, window: bool = True) -> DataFrame:
        """Live postings of ``jobs`` (with event time ``e``) that the filter lets through; a skill is a semi-join."""
        found = jobs.filter(live() & self.predicates())
        if window:
            found = found.filter(self.window())
        if self.skill is not None and bridge is not None:
            found = found.join(bridge.filter(F.col("slug") == self.skill).select(F.col("job_id").alias("id")), "id", "left_semi")
        return found


def between(start: datetime, end: datetime) -> Column:
    """Half-open comparison window on the event time."""
    return (F.col("e") >= at(start)) & (F.col("e") < at(end))


def compare(left: Column, operator: Column, right: Column) -> Column:
    """Comparison by name: gt, gte, lt, lte, eq; null for others."""
    return (
        F.when(operator == "gt", left > right).when(operator == "gte", left >= right).when(operator == "lt", left < right)
        .when(operator == "lte", left <= right).when(operator == "eq", left == right)
    )
