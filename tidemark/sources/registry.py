"""Declared sources: a mapping of definitions to readers; unknown kinds and repeated names are errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import api, feeds, files, synthetic

KINDS = ("dataset", "api", "career", "rss", "synthetic")


@dataclass(frozen=True)
class Definition:
    name: str
    kind: str
    options: dict = field(default_factory=dict)
    enabled: bool = True


class Registry:
    def __init__(self, definitions: list[Definition] | None = None) -> None:
        self.by_name: dict[str, Definition] = {}
        for d in definitions or [Definition("synthetic", "synthetic", {"count": 100})]:
            self.add(d)

    @classmethod
    def from_mapping(cls, config: dict) -> Registry:
        """From ``{"sources": [{"name", "kind", "enabled", ...options}]}``."""
        rows = [dict(r) for r in config.get("sources", [])]
        return cls([Definition(r.pop("name"), r.pop("kind"), enabled=r.pop("enabled", True), options=r) for r in rows])

    def add(self, d: Definition) -> None:
        if d.kind not in KINDS:
            raise ValueError(f"no source kind {d.kind}")
        if d.name in self.by_name:
            raise ValueError(f"source {d.name} is declared twice")
        self.by_name[d.name] = d

    def read(self, spark: SparkSession, name: str, as_of: datetime) -> DataFrame:
        d = self.by_name[name]
        if d.kind == "dataset":
            return files.dataset(spark, source=name, **d.options)
        if d.kind == "api":
            return api.read(spark, name, **d.options)
        if d.kind == "career":
            return api.career_page(spark, **d.options)
        if d.kind == "rss":
            return feeds.entries(spark.read.text(d.options["path"], wholetext=True).withColumnRenamed("value", "document"), name, d.options.get("company"))
        return synthetic.postings(spark, as_of=as_of, **d.options)
