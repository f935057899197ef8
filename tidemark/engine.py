"""One object for all questions: tables in, DataFrames out, with an optional cache by question and filter."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.filters import AnalyticsFilter, event_time, live
from tidemark.operators import alerts, association, distribution, market, salary, search, skills, trends, volume
from tidemark.schemas import LEVELS


class ResultCache:
    """Persisted results by key, for ``ttl`` seconds; keys that share a prefix are dropped together."""

    def __init__(self, ttl: float = 900.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.clock, self.held = ttl, clock, {}

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.held.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            if found is not None:
                found[1].unpersist()
            found = self.held[key] = (self.clock(), make().persist())
        return found[1]

    def invalidate(self, prefix: str = "") -> int:
        gone = [k for k in self.held if k.startswith(prefix)]
        for k in gone:
            self.held.pop(k)[1].unpersist()
        return len(gone)


class Engine:
    """Analytics over postings, the skill bridge (job_id, slug, confidence) and a skill dimension."""

    def __init__(self, jobs: DataFrame, bridge: DataFrame, skill_dimension: DataFrame | None = None, cache: ResultCache | None = None, remote: Column | None = None) -> None:
        self.jobs = jobs if "e" in jobs.columns else jobs.withColumn("e", event_time())
        self.bridge, self.dimension, self.cache = bridge, skill_dimension, cache
        self.live = self.jobs.filter(live())
        self.remote = remote if remote is not None else F.col("remote_type") == "remote"

    def _asked(self, family: str, flt: AnalyticsFilter, make: Callable[[], DataFrame], *parts: object) -> DataFrame:
        if self.cache is None:
            return make()
        return self.cache.get(":".join(["tidemark", "v1", family, *map(str, parts), flt.cache_key()]), make)

    def _window(self, flt: AnalyticsFilter) -> DataFrame:
        return flt.apply(self.jobs, self.bridge)

    def volume(self, flt: AnalyticsFilter) -> DataFrame:
        end = flt.date_to or flt.as_of
        return self._asked("volume", flt, lambda: volume.dense(self._window(flt), str(flt.start.date()), str(end.date())))

    def overview(self, flt: AnalyticsFilter) -> DataFrame:
        return self._asked("overview", flt, lambda: market.overview(self.jobs, self._window(flt), self.remote, flt.as_of))

    def demand(self, flt: AnalyticsFilter) -> DataFrame:
        return self._asked("skills", flt, lambda: skills.demand(self._window(flt), self.bridge, self.dimension, flt.limit))

    def skill_trend(self, flt: AnalyticsFilter, slug: str, windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
        return self._asked("trend", flt, lambda: trends.windows(self.live, self.bridge.filter(F.col("slug") == slug), flt.as_of.date(), windows), slug)

    def top_trends(self, flt: AnalyticsFilter, limit: int = 10, direction: str | None = None) -> DataFrame:
        return self._asked("trends", flt, lambda: trends.top(self.live, self.bridge, flt.as_of.date(), limit=limit, direction=direction, window=self._window(flt)), limit, direction)

    def fastest_growing(self, flt: AnalyticsFilter, days: int = 30, limit: int = 5) -> DataFrame:
        return self._asked("fastest", flt, lambda: trends.fastest(self.live, self.bridge, flt.as_of.date(), days, limit, window=self._window(flt)), days, limit)

    def emerging(self, flt: AnalyticsFilter, limit: int = 10) -> DataFrame:
        return self._asked("emerging", flt, lambda: trends.emerging(self.live, self.bridge, flt.as_of, flt.window_days, limit), limit)

    def cooccurrence(self, flt: AnalyticsFilter, limit: int = 50, skill: str | None = None) -> DataFrame:
        return self._asked("cooccurrence", flt, lambda: association.cooccurrence(self._window(flt), self.bridge, limit, skill=skill), limit, skill)

    def related(self, flt: AnalyticsFilter, slug: str, limit: int = 10) -> DataFrame:
        return self._asked("related", flt, lambda: association.related(self._window(flt), self.bridge, slug, limit), slug, limit)

    def graph(self, flt: AnalyticsFilter, limit: int = 40) -> tuple[DataFrame, DataFrame]:
        return association.graph(self._window(flt), self.bridge, limit, self.dimension)

    def salaries(self, flt: AnalyticsFilter) -> DataFrame:
        return self._asked("salaries", flt, lambda: salary.overview(self._window(flt)))

    def salaries_by(self, flt: AnalyticsFilter, dimension: str, limit: int = 20) -> DataFrame:
        if dimension not in salary.DIMENSIONS:
            raise ValueError(f"no salary dimension {dimension}")
        return self._asked("salaries_by", flt, lambda: salary.by(self._window(flt), dimension, limit=limit), dimension, limit)

    def locations(self, flt: AnalyticsFilter, by: str = "country") -> DataFrame:
        keys = ["country"] if by == "country" else ["city", "region", "country"]
        return self._asked("locations", flt, lambda: market.places(self._window(flt), keys, self.remote, flt.limit), by)

    def remote_change(self, flt: AnalyticsFilter) -> DataFrame:
        scoped = self.live.filter(flt.predicates())
        return self._asked("remote", flt, lambda: distribution.share_change(scoped, self.remote, flt.as_of, flt.window_days))

    def seniority(self, flt: AnalyticsFilter) -> DataFrame:
        return self._asked("seniority", flt, lambda: distribution.zero_filled(self._window(flt), "experience_level", list(LEVELS)))

    def segments(self, flt: AnalyticsFilter, limit: int = 15) -> DataFrame:
        return self._asked("segments", flt, lambda: market.segments(self.live, self._window(flt), self.bridge, self.remote, flt.as_of, flt.window_days, limit), limit)

    def companies(self, flt: AnalyticsFilter, limit: int = 20) -> DataFrame:
        return self._asked("companies", flt, lambda: market.hiring(self.live, self._window(flt), self.remote, flt.as_of, flt.window_days, limit), limit)

    def company(self, flt: AnalyticsFilter, name: str) -> DataFrame:
        """Profile of one company, found by name among all."""
        own = F.col("company_name") == name
        return market.hiring(self.live.filter(own), self._window(flt).filter(own), self.remote, flt.as_of, flt.window_days, 1)

    def explorer(self, flt: AnalyticsFilter, slug: str) -> dict[str, DataFrame]:
        """All about one skill."""
        scoped = self._window(flt).join(self.bridge.filter(F.col("slug") == slug).select(F.col("job_id").alias("id")), "id", "left_semi")
        return {
            "trend": self.skill_trend(flt, slug), "related": self.related(flt, slug), "salary": salary.overview(scoped), "remote": distribution.one(scoped, "remote_type"),
            "seniority": distribution.one(scoped, "experience_level"), "locations": market.places(scoped, ["country"], self.remote), "companies": distribution.one(scoped, "company_name").orderBy(F.desc("n"), "value").limit(10),
        }

    def report(self, flt: AnalyticsFilter) -> dict[str, DataFrame]:
        return {"overview": self.overview(flt), "skills": self.demand(flt), "trends": self.top_trends(flt), "emerging": self.emerging(flt), "salaries": self.salaries(flt), "locations": self.locations(flt), "companies": self.companies(flt)}

    def search(self, postings: DataFrame, query: str, limit: int = 25, offset: int = 0) -> DataFrame:
        return search.ranked(postings, query, limit, offset)

    def facets(self, dimensions: list[str]) -> DataFrame:
        return distribution.facets(self.live, dimensions, self.bridge)

    def alerts(self, rules: DataFrame, flt: AnalyticsFilter) -> DataFrame:
        """Rules with value, triggered and suppressed, over the filter's window."""
        change = trends.windows(self.live, self.bridge, flt.as_of.date(), (flt.window_days,)).select("slug", "change")
        found = alerts.readings(self.jobs, self._window(flt), self.bridge, self.remote, change, self.emerging(flt))
        return alerts.evaluate(rules, found, flt.as_of)

    def admin(self, flt: AnalyticsFilter) -> DataFrame:
        """Counts by source of the last seven days and in all."""
        week = F.col("e") >= F.lit(flt.as_of - timedelta(days=7)).cast("timestamp")
        return self.jobs.groupBy("source").agg(F.count("*").alias("total"), F.count_if(live()).alias("live"), F.count_if(week).alias("last_week"))
