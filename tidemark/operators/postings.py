"""From normalised records to the flat posting that the store, the search and the engine read, and back from the store to the engine.

A posting has the 37 columns of the store as plain values, and beside them what stays out of it: the found skills as structs, the
description and its snippet, the search text, keys of duplicates, event time. Unknown values are null, unknown members of a vocabulary "unknown".
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.filters import event_time
from tidemark.functions import stats
from tidemark.functions import text as tx
from tidemark.operators import quality, records, skillmatch

#: Name of a country by its code: the first long key of the table of places.
COUNTRY_NAMES = {code: name.title() for name, code in reversed(records.COUNTRIES.items()) if len(name) > 3}
#: Segment by category of skill, for titles that name none; a deployment brings its own.
HINTS = {"cloud": "devops", "database": "data_engineering", "framework": "backend_engineering"}
#: Longest values of a posting.
MOST_TITLE, MOST_NORMALISED, MOST_FAMILY, MOST_SEARCH = 512, 256, 128, 8000


def _has() -> dict[str, Column]:
    """Which of the weighted fields a posting has, in order of their weights' table."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")) != "unknown"
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return {
        "title": filled("title"), "description": filled("description"), "company": filled("company_name"), "location": F.coalesce("city", "country_code").isNotNull(),
        "published_at": F.col("published_at").isNotNull(), "url": filled("canonical_url"), "employment_type": known("employment_type"), "remote_type": known("remote_type"),
        "salary": F.col("salary_provenance") == "observed", "skills": F.size("found_skills") > 0,
    }


def score() -> Column:
    """Quality of one posting: what it has, and how sure its title, place, salary (0.5 if none is seen) and skills are; at most 1."""
    sum_of = F.aggregate("found_skills", F.lit(0.0), lambda a, s: a + s["confidence"])
    skills = F.when(F.size("found_skills") > 0, sum_of / F.size("found_skills"))
    salary = F.when(F.col("salary_provenance") == "observed", F.col("salary_confidence")).otherwise(0.5)
    return F.least(F.lit(1.0), quality.record_score(_has(), [F.col("title_confidence"), F.col("location_confidence"), salary, skills]))


def flat(normalised: DataFrame, seen_at: datetime, status: str = "active", taxonomy: skillmatch.Taxonomy = skillmatch.DEFAULT, hints: dict[str, str] | None = None, countries: dict[str, str] | None = None) -> DataFrame:
    """One row of plain columns for each row of ``records.normalise``; ``seen_at`` stands in for a missing time of collection."""
    found = skillmatch.extract(F.col("title"), F.col("description"), taxonomy)
    rows = normalised.withColumn("found_skills", F.coalesce(found, F.array().cast(found_type(normalised, found))))
    name_of = F.create_map(*[F.lit(x) for pair in (countries or COUNTRY_NAMES).items() for x in pair])
    seen = F.coalesce("collected_at", F.lit(seen_at).cast("timestamp"))
    title, company, place, salary, years = (F.col(f"{c}_n") for c in ("title", "company", "location", "salary", "years"))
    out = rows.select(
        "id", "source", "source_kind", "source_job_id", "canonical_url", "url_fingerprint", "content_hash", "industry", "description", F.col("snippet"), "found_skills",
        F.substring(F.coalesce("title", F.lit("Untitled")), 1, MOST_TITLE).alias("title"), F.substring(title["canonical"], 1, MOST_NORMALISED).alias("normalized_title"),
        F.substring(title["family"], 1, MOST_FAMILY).alias("title_family"), title["specialization"].alias("specialization"), title["confidence"].alias("title_confidence"),
        company["name"].alias("company_name"), company["slug"].alias("company_slug"), skillmatch.segment(title["segment"], title["confidence"], F.col("found_skills"), HINTS if hints is None else hints).alias("segment"),
        F.col("location").alias("location_raw"), place["country_code"].alias("country_code"), F.try_element_at(name_of, place["country_code"]).alias("country"), place["region"].alias("region"), place["city"].alias("city"), place["confidence"].alias("location_confidence"),
        "remote_type", F.col("employment_n.type").alias("employment_type"), F.col("level_n.level").alias("experience_level"), years["years_min"].alias("experience_years_min"), years["years_max"].alias("experience_years_max"),
        salary["min_amount"].alias("salary_min"), salary["max_amount"].alias("salary_max"), F.coalesce(salary["normalized_currency"], salary["currency"]).alias("salary_currency"), salary["period"].alias("salary_period"), salary["provenance"].alias("salary_provenance"),
        salary["annual_min"].alias("salary_annual_min"), salary["annual_max"].alias("salary_annual_max"), salary["confidence"].alias("salary_confidence"), F.col("language_n.code").alias("language"),
        F.lit(status).alias("status"), "published_at", seen.alias("first_seen_at"), F.lit(seen_at).cast("timestamp").alias("last_seen_at"), F.lit(None).cast("string").alias("duplicate_of"),
    )
    named = F.concat_ws(" ", "title", "normalized_title", "company_name", "location_raw", F.concat_ws(" ", F.transform("found_skills", lambda s: s["name"])), "snippet")
    e = F.coalesce("published_at", "first_seen_at")
    return out.withColumns({
        "skills": F.array_sort(F.array_distinct(F.transform("found_skills", lambda s: s["slug"]))), "skill_count": F.size("found_skills"), "quality_score": score(),
        "salary_mid": stats.midpoint(F.col("salary_annual_min"), F.col("salary_annual_max")), "search_text": F.substring(tx.canonical_key(named, True), 1, MOST_SEARCH),
        "e": e, "year": F.year(e), "month": F.month(e), "day": F.dayofmonth(e),
    })


def found_type(rows: DataFrame, column: Column):
    return rows.select(column.alias("c")).schema["c"].dataType


def from_raw(raw: DataFrame, as_of: datetime, **how) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined records) of raw records: cleaned, validated, normalised, flat."""
    valid, bad = records.split_valid(records.validate(records.clean(raw), as_of))
    return flat(records.normalise(valid), as_of, **how), bad


def stored(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, bridge) of the columnar store as the engine takes them. The store holds no duplicates and no confidence of skills."""
    jobs = store.withColumns({"e": event_time(), "salary_mid": stats.midpoint(F.col("salary_annual_min"), F.col("salary_annual_max")), "duplicate_of": F.lit(None).cast("string")})
    bridge = store.select(F.col("id").alias("job_id"), F.explode("skills").alias("slug"))
    return jobs, bridge
