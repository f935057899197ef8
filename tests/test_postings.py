"""Raw records to the store and the engine."""

from datetime import datetime

import pytest

from tidemark.engine import Engine
from tidemark.filters import AnalyticsFilter
from tidemark.operators import maintenance, postings, search
from tidemark.schemas import EXPORT, RAW
from tidemark.sources import files

NOW = datetime(2024, 6, 1)
BODY = "Requirements:\nSeveral years with Python and PostgreSQL. You build services with Docker and talk to customers about what they need."


def raw(spark, *rows):
    full = [{"source": "s", "source_kind": "dataset", "published_at": datetime(2024, 5, 20), "collected_at": NOW, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in RAW) for r in full], RAW)


def test_to_store_and_engine(spark, tmp_path):
    given = raw(
        spark,
        {"source_job_id": "1", "url": "https://example.com/1", "title": "Senior Backend Engineer", "company": "Acme GmbH", "location": "Berlin, Germany", "salary": "60k - 80k USD per year", "employment_type": "Full-time", "description": BODY},
        {"source_job_id": "2", "title": "Clerk", "description": "Somebody to file letters in a quiet office, from nine to five each day.", "published_at": None, "collected_at": None},
        {"source_job_id": "3", "title": "Clerk", "description": "short"},
    )
    flat, bad = postings.from_raw(given, NOW)
    assert set(EXPORT.names) <= set(flat.columns) and [r.reason for r in bad.collect()] == ["description_too_short"]
    one, two = flat.orderBy("source_job_id").collect()
    assert (one.company_slug, one.country, one.city, one.segment, one.experience_level) == ("acme", "Germany", "Berlin", "backend_engineering", "senior")
    assert one.skills == sorted(one.skills) and {"python", "postgresql", "docker"} <= set(one.skills) and one.skill_count == len(one.found_skills)
    assert one.salary_mid == 70_000 and one.salary_currency == "USD" and "postgresql" in one.search_text and one.quality_score > two.quality_score > 0
    assert (two.skills, two.skill_count, two.salary_provenance, two.country, two.e) == ([], 0, "unknown", None, NOW)
    mean = sum(s.confidence for s in one.found_skills) / len(one.found_skills)
    weights = 9.7 - (0.6 if one.remote_type == "unknown" else 0.0)
    assert one.quality_score == pytest.approx(0.65 * weights / 9.7 + 0.35 * (one.title_confidence + one.location_confidence + one.salary_confidence + mean) / 4, abs=1e-4)
    files.export(flat, str(tmp_path / "store"))
    jobs, bridge = postings.stored(files.store(spark, str(tmp_path / "store")))
    row = Engine(jobs, bridge).overview(AnalyticsFilter(as_of=NOW)).first()
    assert (row.active_jobs, row.companies, row.countries, row.samples, row.median_salary) == (2, 2, 1, 1, 70_000.0)
    named = maintenance.job_skills(flat.withColumn("skills", flat.found_skills))
    assert {(r.job_id, r.slug) for r in named.collect()} == {(r.job_id, r.slug) for r in bridge.collect()}
    assert [r.source_job_id for r in search.ranked(flat, "postgresql").collect()] == ["1"]


def test_no_records(spark):
    flat, bad = postings.from_raw(raw(spark), NOW)
    assert flat.count() == 0 and bad.count() == 0
