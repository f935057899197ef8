"""Record operators on stated inputs with stated results."""

from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import dates, stats, text, urls
from tidemark.operators import dedup, quality, records, skillmatch

CASES: list[tuple] = []


def fixture(name: str, inputs: list[str], make: Callable[..., list[Column]], rows: list[tuple], outputs: list[str], kinds: str | None = None) -> None:
    """Rows hold the inputs, then the expected outputs; every input is text, null too."""
    CASES.append((name, inputs, make, rows, outputs))


def parts(make: Callable[..., Column], *names: str) -> Callable[..., list[Column]]:
    return lambda *c: [make(*c)[n] for n in names]


fixture("salary_parse", ["raw"], parts(records.salary, "min_amount", "max_amount", "currency", "period", "provenance"), [
    ("45,000 - 60,000 EUR per year", 45000.0, 60000.0, "EUR", "yearly", "observed"), ("$120k - $150k", 120000.0, 150000.0, "USD", "yearly", "observed"),
    ("60.000 - 80.000 EUR brutto/Jahr", 60000.0, 80000.0, "EUR", "yearly", "observed"), ("50 USD/hour", 50.0, None, "USD", "hourly", "observed"),
    ("PLN 15 000 - 20 000 monthly", 15000.0, 20000.0, "PLN", "monthly", "observed"), ("Competitive salary", None, None, None, "unknown", "unknown"),
    ("Founded in 2018", None, None, None, "unknown", "unknown"), (None, None, None, None, "unknown", "unknown"), ("3 USD per year", None, None, None, "unknown", "unknown"),
], ["min_amount", "max_amount", "currency", "period", "provenance"], "min_amount:DOUBLE max_amount:DOUBLE")
fixture("salary_convert", ["raw"], parts(records.salary, "annual_min", "normalized_currency"), [("5,000 EUR per month", 5000 * 12 * 1.09, "USD"), ("70000 USD a year", 70000.0, "USD")], ["annual_min", "normalized_currency"], "annual_min:DOUBLE")
fixture("amount_parse", ["amount", "suffix"], lambda a, b: [records.parse_amount(a, b)], [("60,000", None, 60000.0), ("60.000", None, 60000.0), ("60", "k", 60000.0), ("1.5", "M", 1500000.0), ("1.234,56", None, 1234.56)], ["value"], "value:DOUBLE")
fixture("company_normalise", ["raw"], parts(records.company, "name", "slug"), [("Acme GmbH", "Acme", "acme"), ("ACME GMBH", "Acme", "acme"), ("Acme Inc.", "Acme", "acme"), ("Acme (via TalentPartners)", "Acme", "acme"), ("Acme Holding GmbH & Co. KG", "Acme Holding", "acme-holding"), ("IBM", "IBM", "ibm"), (None, "Unknown", "unknown")], ["name", "slug"])
fixture("title_rules", ["raw"], parts(records.title, "canonical", "family", "seniority"), [
    ("Senior Python Developer", "Senior Software Engineer", "Software Engineering", "senior"), ("Backend Python Developer", "Backend Engineer", "Backend Engineering", "unknown"),
    ("Senior Backend Python Engineer (m/f/d)", "Senior Backend Engineer", "Backend Engineering", "senior"), ("Data Engineer", "Data Engineer", "Data Engineering", "unknown"),
    ("Working Student Data Science", "Intern Data Scientist", "Data Science", "intern"), ("Staff SRE", "Principal DevOps Engineer", "DevOps", "principal"),
    ("QA Automation Tester", "QA Engineer", "Quality Assurance", "unknown"), ("Head of Engineering", "Software Engineering Director", "Software Engineering", "director"), ("", "Other", "Other", "unknown"),
], ["canonical", "family", "seniority"])
fixture("location_normalise", ["raw"], parts(records.location, "city", "region", "country_code"), [("Berlin, Germany", "Berlin", "Berlin", "DE"), ("Austin, TX", "Austin", "Texas", "US"), ("US-TX-Austin", "Austin", "Texas", "US"), ("Bengaluru, India", "Bengaluru", "Karnataka", "IN"), ("London / Hybrid", "London", "England", "GB")], ["city", "region", "country_code"])
fixture("remote_type", ["place", "hint"], lambda a, b: [records.remote_type(a, b, F.lit(None).cast("string"))], [("Remote", None, "remote"), ("Berlin (Hybrid)", None, "hybrid"), ("On-site, Munich", None, "onsite"), ("Berlin", None, "unknown"), ("Berlin", "true", "remote")], ["remote_type"])
fixture("employment_type", ["raw", "title"], lambda a, b: [records.employment_type(a, b, F.lit(None).cast("string"))[k] for k in ("type", "confidence")], [("Full-time", None, "full_time", 0.95), (None, "Internship Marketing", "internship", 0.75), ("Contract", None, "contract", 0.95), ("Teilzeit", None, "part_time", 0.95), (None, None, "unknown", 0.0)], ["employment_type", "confidence"], "confidence:DOUBLE")
fixture("experience_level", ["body", "title_level"], lambda a, b: [records.experience_level(b, records.experience_years(a)["years_min"])[k] for k in ("level", "confidence")], [("5+ years", "senior", "senior", 0.9), ("10+ years", "junior", "principal", 0.6), ("at least 4 years", "unknown", "mid", 0.75), ("none", "senior", "senior", 0.55), ("none", "unknown", "unknown", 0.0)], ["level", "confidence"], "confidence:DOUBLE")
fixture("experience_years_rules", ["body"], parts(records.experience_years, "years_min", "years_max"), [("3-5 years of experience", 3.0, 5.0), ("at least 4 years of experience", 4.0, None), ("7+ years", 7.0, None), ("5 years of professional experience", 5.0, None), ("none", None, None)], ["years_min", "years_max"], "years_min:DOUBLE years_max:DOUBLE")
fixture("parse_datetime", ["raw"], lambda c: [F.date_format(dates.parse_datetime(c), "yyyy-MM-dd HH:mm")], [("2024-03-01T10:00:00Z", "2024-03-01 10:00"), ("2024-03-01 10:00:00", "2024-03-01 10:00"), ("Fri, 01 Mar 2024 10:00:00 GMT", "2024-03-01 10:00"), ("1709287200", "2024-03-01 10:00"), ("1709287200000", "2024-03-01 10:00"), ("not a date", None), (None, None)], ["moment"])
fixture("html_and_mojibake", ["raw"], lambda c: [text.clean_text(text.repair_mojibake(c))], [("<div><p>Hello <b>World</b></p><script>alert(1)</script></div>", "Hello World"), ("<p>Hello&nbsp;&amp;   welcome</p>", "Hello & welcome"), ("Weâ€™re hiring", "We're hiring"), (None, "")], ["value"])
fixture("url_rules", ["raw"], lambda c: [urls.normalize_url(c)], [("HTTPS://WWW.Example.com:443/jobs/1/?utm_source=x&b=2&a=1#frag", "https://example.com/jobs/1?a=1&b=2"), ("example.com", "https://example.com/"), (None, "")], ["value"])
fixture("contains_word", ["raw"], lambda c: [text.contains_word(c, "go")], [("we use go daily", True), ("golang is great", False), ("GO!", True)], ["found"], "found:BOOLEAN")
fixture("location_display", ["city", "region", "country", "raw"], lambda a, b, c, d: [text.display_location(a, b, c, d)], [("Berlin", "Berlin", "Germany", "x", "Berlin, Germany"), (None, None, None, " raw ", "raw"), (None, None, None, None, "Unknown")], ["value"])
fixture("annual_midpoint", ["low", "high", "period"], lambda a, b, p: [stats.annualised(stats.midpoint(a.cast("double"), b.cast("double")), p)], [("10", "20", "monthly", 180.0), ("10", None, "hourly", 20800.0), (None, None, "yearly", None), ("1", "3", "unknown", None)], ["value"], "value:DOUBLE")
fixture("skill_extract", ["title", "body"], lambda a, b: [F.array_join(F.transform(skillmatch.top(skillmatch.extract(a, b), 60), lambda s: s["slug"]), ",")], [("", "We go to the office daily.", ""), ("", "Stack: Python, Go, Rust", "python,rust,go"), ("", "Series C round", ""), ("", "Stack: C++, C# and Python", "python,cpp,csharp")], ["slugs"])


@pytest.mark.parametrize(("name", "inputs", "make", "rows", "outputs"), CASES, ids=[c[0] for c in CASES])
def test_stated(spark, name, inputs, make, rows, outputs):
    given = spark.createDataFrame([(i, *r[: len(inputs)]) for i, r in enumerate(rows)], "_i int, " + ", ".join(f"{c} string" for c in inputs))
    made = given.select("_i", *[m.alias(o) for m, o in zip(make(*[F.col(c) for c in inputs]), outputs, strict=True)])
    for got in made.collect():
        for value, want in zip(got[1:], rows[got[0]][len(inputs):], strict=True):
            assert value == (pytest.approx(want) if isinstance(want, float) else want), (name, rows[got[0]])


def test_verdict_cascade(spark):
    body = " ".join(f"sentence number {i} tells about work {i * 7}" for i in range(40))
    rows = [("a", 1, "s1/1", "u1", "h1", body), ("b", 2, "s1/1", "u2", "h2", "other"), ("c", 3, "s2/3", "u1", "h3", "third"), ("d", 4, "s3/4", "u4", "h1", "fourth"), ("e", 5, "s4/5", "u5", "h5", "intro " + body)]
    found = dedup.dedup(spark.createDataFrame(rows, "id string, ord int, natural_key string, url_fingerprint string, content_hash string, text string"), 0.7, 32)
    assert {(r.id, r.kind, r.duplicate_of) for r in found.collect()} == {("a", None, None), ("b", "exact_source", "a"), ("c", "url", "a"), ("d", "content", "a"), ("e", "near", "a")}


def test_grades_and_events(spark):
    dims = spark.createDataFrame([("a", 1.0, 0.85, 0.5, 1.0, 0.6, 0.2), ("b", 0.9, 1.0, 1.0, 1.0, 0.9, 0.9)], "source string, completeness double, validity double, uniqueness double, consistency double, accuracy double, freshness double")
    assert {(r.source, round(r.score, 6), r.grade) for r in quality.graded(dims).collect()} == {("a", 0.755, "C"), ("b", 0.95, "A")}
    assert {(r.dimension, r.severity) for r in quality.events(dims.filter("source = 'a'")).collect()} == {("validity", "warning"), ("uniqueness", "warning"), ("freshness", "error")}


def test_places_are_trimmed(spark):
    """A part beside a bracket keeps no space of it."""
    found = spark.createDataFrame([("Austin (Remote)",), ("Austin ( Texas )",)], "raw string").select(records.location(F.col("raw"))["city"].alias("city"))
    assert [r.city for r in found.collect()] == ["Austin", "Austin"]


def test_verdicts_of_documents(spark):
    """The query over whole documents against a greedy pass in plain Python."""
    import os

    import numpy as np

    from tidemark.plans import fixtures, registry

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    rows = sorted(fixtures.cascade_records(spark, folder).collect(), key=lambda r: r.ord)
    first, want, accepted = {}, {}, []
    for r in rows:
        keys = [("exact_source", r.natural_key), ("url", r.url_fingerprint), ("content", r.content_hash)]
        hit = next(((kind, first[kind, key]) for kind, key in keys if (kind, key) in first), (None, None))
        for k in keys:
            first.setdefault(k, r.id)
        want[r.id] = hit
        if hit[0] is not None:
            continue
        sig = np.array(dedup.minima(dedup.shingle_hashes(r.text)))
        near = []
        for other, theirs in accepted:
            if len(sig) and len(theirs) and (sig.reshape(dedup.BANDS, -1) == theirs.reshape(dedup.BANDS, -1)).all(axis=1).any():
                score = float((sig == theirs).mean())
                if score >= 0.85:
                    near.append((-score, other))
        if near:
            want[r.id] = ("near", min(near)[1])
        else:
            accepted.append((r.id, sig))
    found = {r.id: (r.kind, r.duplicate_of) for r in registry.queries()["dedup_verdicts"](spark, folder).collect()}
    assert found == want and {k for k, _ in want.values()} == {None, "exact_source", "url", "content", "near"}
