"""Search over postings: multi-word matching, a relevance score, suggestions and pages.

A posting row has id, e, title, company_name, skills, snippet, search_text and quality_score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import canonical_key_of

MAX_QUERY, MAX_TERMS, MIN_PREFIX = 200, 12, 2
WEIGHTS = {"title": 3.0, "skill": 2.5, "company": 1.5, "snippet": 1.0}


def terms(query: str | None) -> list[str]:
    """At most twelve canonical terms of the first 200 characters; order doesn't matter."""
    return canonical_key_of((query or "")[:MAX_QUERY]).split()[:MAX_TERMS]


def matching(postings: DataFrame, query: str | None) -> DataFrame:
    """Postings whose search text contains every term."""
    found = [F.contains("search_text", F.lit(t)) for t in terms(query)]
    return postings.filter(reduce(lambda a, b: a & b, found)) if found else postings


def _holds(array: str, term: str) -> Column:
    return F.exists(array, lambda s: F.contains(F.lower(s), F.lit(term)))


def relevance(words: list[str]) -> Column:
    """Per term: title 3, a skill 2.5, company 1.5, snippet 1; plus the quality score."""
    one = lambda test, weight: F.when(test, weight).otherwise(0.0)
    score = F.coalesce("quality_score", F.lit(0.0))
    for t in words:
        score = score + one(F.contains(F.lower("title"), F.lit(t)), WEIGHTS["title"]) + one(_holds("skills", t), WEIGHTS["skill"])
        score = score + one(F.contains(F.lower("company_name"), F.lit(t)), WEIGHTS["company"]) + one(F.contains(F.lower("snippet"), F.lit(t)), WEIGHTS["snippet"])
    return F.round(score, 3)


def ranked(postings: DataFrame, query: str, limit: int = 25, offset: int = 0) -> DataFrame:
    """Matches in order of relevance over all of them, newest first among equals."""
    return matching(postings, query).withColumn("score", relevance(terms(query))).orderBy(F.desc("score"), F.desc("e"), "id").offset(offset).limit(limit)


def full_text(postings: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Whole-word search: all terms are tokens; ranked by how often they occur against the length."""
    words = terms(query)
    tokens = F.split("search_text", " ")
    found = postings.withColumn("_t", tokens).filter(reduce(lambda a, b: a & b, [F.array_contains("_t", w) for w in words], F.lit(bool(words))))
    hits = F.size(F.filter("_t", lambda x: x.isin(words)))
    return found.withColumn("score", hits / F.size("_t")).drop("_t").orderBy(F.desc("score"), "id").limit(limit)


def suggest(postings: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(title, n): titles that start with the prefix (two characters at least), most frequent first."""
    key = prefix.strip().lower()
    found = postings.filter(F.startswith(F.lower("title"), F.lit(key)) & F.lit(len(key) >= MIN_PREFIX))
    return found.groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(limit)


def page(postings: DataFrame, key: str, descending: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """One page in a total order: the key, then id."""
    first = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    return postings.orderBy(first, "id").offset(offset).limit(limit)


def salary_overlap(low: float | None, high: float | None) -> Column:
    """Ranges that overlap; unknown bounds fail."""
    test = F.lit(True)
    if low is not None:
        test = test & (F.col("salary_annual_max") >= low)
    if high is not None:
        test = test & (F.col("salary_annual_min") <= high)
    return test
