"""Listings by many optional predicates, and the bookkeeping of ingestion."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import listing, runs

T = [datetime(2024, 1, d) for d in range(1, 9)]
COLUMNS = (
    "id long, status string, duplicate_of long, source string, company_slug string, company_name string, country_code string, city string, remote_type string, employment_type string, "
    "experience_level string, segment string, normalized_title string, search_text string, salary_annual_min double, salary_annual_max double, salary_provenance string, "
    "published_at timestamp, first_seen_at timestamp, last_seen_at timestamp, content_hash string, signature array<long>"
)


@pytest.fixture(scope="module")
def jobs(spark):
    one = lambda i, status="active", dup=None, title="Backend Engineer", pay=(50.0, 70.0, "observed"): (
        i, status, dup, f"s{i % 2}", "acme", "Acme", "DE", "Berlin", "remote", "full_time", "senior", "it", title, title.lower() + " python berlin", *pay, T[i], T[i], T[i], f"h{i}", [i])
    rows = [one(1), one(2, title="Data Scientist"), one(3, pay=(None, None, "unknown")), one(4, dup=1), one(5, status="expired"), one(6, status="updated"), one(7, pay=(None, None, None))]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def bridge(spark):
    return spark.createDataFrame([(1, "python", 0.9), (1, "go", 0.8), (6, "python", 0.7)], "job_id long, slug string, confidence double")


shown, span = listing.shown, listing.span


@pytest.mark.parametrize(
    "wanted,asked,paged,expected",
    [
        ([], {}, {}, [7, 6, 3, 2, 1]), ([], {}, {"descending": False}, [1, 2, 3, 6, 7]), ([lambda: F.lit(True)], {}, {}, [7, 6, 5, 4, 3, 2, 1]), ([shown, lambda: listing.one_of("source", "s0")], {}, {}, [6, 2]),
        ([shown, lambda: listing.title_contains("Data  SCIENTIST")], {}, {}, [2]), ([shown, lambda: listing.has_salary(True)], {}, {}, [6, 2, 1]), ([shown, lambda: listing.has_salary(False)], {}, {}, [3]),
        ([shown, lambda: listing.pays(60)], {}, {}, [6, 2, 1]), ([shown, lambda: listing.pays(None, 40)], {}, {}, []),
        ([shown, lambda: span("published_at", T[2], T[3])], {}, {}, [3, 2]), ([shown, lambda: span("first_seen_at", T[6])], {}, {}, [7, 6]), ([], {"text": "berlin backend"}, {}, [7, 6, 3, 1]),
        ([], {"slugs": ("python", "go", "go")}, {}, [1]), ([], {"slugs": ("python", "go"), "every": False}, {}, [6, 1]),
        ([shown, lambda: listing.named("city", "BERLIN"), lambda: listing.named("country_code", "de")], {}, {"limit": 2, "offset": 1}, [6, 3]), ([shown, lambda: listing.one_of("company_slug", "other")], {}, {}, []),
        ([], {}, {"order": "salary", "descending": True}, [1, 2, 6, 3, 7]),
    ],
)
def test_listing(jobs, bridge, wanted, asked, paged, expected):
    found = listing.matching(jobs, *[w() for w in wanted], bridge=bridge, **asked)
    assert [r.id for r in listing.page(found, **paged).collect()] == expected


def test_listing_refuses(jobs):
    with pytest.raises(ValueError):
        listing.page(jobs, "size")
    with pytest.raises(ValueError):
        listing.matching(jobs, slugs=("go",))


def test_with_skills(spark, jobs, bridge):
    dimension = spark.createDataFrame([("python", "Python", "language")], "slug string, name string, category string")
    got = {r.id: [(s.slug, s.name, s.category, s.confidence) for s in r.skills] for r in listing.with_skills(jobs, bridge, dimension).collect()}
    assert got[1] == [("go", "go", "other", 0.8), ("python", "Python", "language", 0.9)] and got[2] == [] and len(got) == 7


def test_recent_and_oldest(jobs):
    assert [(r.id, r.content_hash, r.signature) for r in listing.recent_signatures(jobs, T[3], 2).collect()] == [(7, "h7", [7]), (6, "h6", [6])]
    assert listing.recent_signatures(jobs, T[1], companies=["Other"]).count() == 0
    assert [r.id for r in listing.oldest_first(jobs, 3).collect()] == [1, 2, 3]


def test_cursors(spark):
    states = spark.createDataFrame([("a", True, T[1], T[1], "c1", T[4], 10, 1, 4, "e1"), ("b", True, None, T[1], None, None, 0, 0, 4, None), ("c", False, None, None, None, None, 0, 0, 0, None)], runs.STATE)
    made = spark.createDataFrame([("a", True, T[5], None, T[3], 5, 2, "e2"), ("b", False, T[5], "x", T[5], 9, 9, "e"), ("d", True, T[5], "c", None, 1, None, None)],
                                 "source string, ok boolean, at timestamp, cursor string, timestamp timestamp, processed long, failed long, etag string")
    got = {r.source: tuple(r)[1:] for r in runs.advance(states, made).collect()}
    assert got["a"] == (True, T[5], T[5], "c1", T[4], 15, 3, 0, "e2") and got["b"] == (True, None, T[5], None, None, 0, 0, 5, None)
    assert got["c"] == (False, None, None, None, None, 0, 0, 0, None) and got["d"] == (True, T[5], T[5], "c", None, 1, 0, 0, None)
    assert sorted(r.source for r in runs.due(runs.advance(states, made)).collect()) == ["a", "d"]


def test_runs(spark):
    kind = "id string, source string, status string, started_at timestamp, finished_at timestamp, records_received long, records_rejected long, jobs_created long, jobs_updated long, duplicates_detected long, quality_score double"
    old = spark.createDataFrame([("1", "a", "success", T[1], T[2], 86400, 1, 2, 3, 4, 0.5), ("2", "a", "running", T[3], None, 0, 0, 0, 0, 0, None)], kind)
    saved = runs.save(old, spark.createDataFrame([("2", "a", "success", T[3], T[4], 10, 1, 1, 1, 1, 1.0)], kind))
    assert {r.id: r.status for r in saved.collect()} == {"1": "success", "2": "success"}
    assert [r.id for r in runs.recent(saved, "a", 1).collect()] == ["2"] and runs.last_successful(old).first().id == "1"
    assert tuple(runs.summary(saved, T[1]).first()) == (2.0, 86410.0, 2.0, 3.0, 4.0, 5.0, 0.75) and tuple(runs.summary(saved, T[7]).first()) == (0.0,) * 7
    assert {r.id: (r.duration_seconds, r.throughput_per_second) for r in runs.with_rates(old, T[3]).collect()} == {"1": (86400.0, 1.0), "2": (0.0, 0.0)}


def test_audit_and_counts(spark):
    created = spark.createDataFrame([(1, "a", "active", 0.5)], "id long, source string, status string, quality_score double")
    twice = spark.createDataFrame([(2, "a", 1, "url", 1.0)], "id long, source string, duplicate_of long, kind string, similarity double")
    got = {r.job_id: (r.event_type, r.payload) for r in runs.audit(created, twice, "r", T[1]).collect()}
    assert got == {"1": ("job.created", {"status": "active", "quality": "0.5"}), "2": ("job.duplicate", {"duplicate_of": "1", "kind": "url", "similarity": "1.0"})}
    rejected = spark.createDataFrame([("x", T[1]), ("x", T[3]), ("y", T[3])], "reason string, rejected_at timestamp")
    assert {r.reason: r.n for r in runs.counts_since(rejected, "reason", "rejected_at", T[2]).collect()} == {"x": 1, "y": 1}


def test_taxonomy_and_links(spark, bridge):
    kind = "slug string, name string, category string, aliases array<string>, "
    known = spark.createDataFrame([("old", "Old", "c", [], None), ("go", "G", "c", ["g"], "old")], kind + "parent_slug string")
    nodes = spark.createDataFrame([("go", "Go", None, None, "lang"), ("lang", None, "c", ["l"], "nowhere")], kind + "parent string")
    assert {tuple(r)[0]: (r.name, r.category, r.aliases, r.parent_slug) for r in runs.sync_taxonomy(known, nodes).collect()} == {"old": ("Old", "c", [], None), "go": ("Go", "other", [], "lang"), "lang": ("lang", "c", ["l"], None)}
    after = runs.replace_job_skills(bridge, spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2, "rust", 0.5)], "job_id long, slug string, confidence double"))
    assert sorted((r.job_id, r.slug) for r in after.collect()) == [(2, "rust"), (6, "python")]


def test_small_answers(spark):
    days = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29)], "year int, month int, day int").select(runs.partition_day().alias("day"))
    assert [r.day for r in days.collect()] == [date(2024, 2, 29), None] and runs.latest_day(days).first().day == date(2024, 2, 29)
    assert runs.unread(spark.createDataFrame([(None,), (T[1],)], "read_at timestamp")).first().n == 1
    assert tuple(runs.averages(spark.createDataFrame([(2.0, None), (None, None)], "experience_years_min double, quality_score double")).first()) == (2.0, 0.0)
    rules = spark.createDataFrame([("a", T[1]), ("b", None)], "rule_id string, last_triggered_at timestamp")
    assert {r.rule_id: r.last_triggered_at for r in runs.mark_triggered(rules, rules.filter(F.col("rule_id") == "b"), T[4]).collect()} == {"a": T[1], "b": T[4]}
