"""Field mapping from payloads: declared dotted paths, literals, or candidate names in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates

# Names under which sources carry a field.
CANDIDATES = {
    "source_job_id": ("id", "job_id", "guid", "slug", "reference", "uuid"), "url": ("url", "link", "absolute_url", "apply_url", "job_url", "applyUrl"),
    "title": ("title", "name", "position", "job_title", "jobTitle"), "description": ("description", "content", "summary", "job_description", "body"),
    "company": ("company", "company_name", "companyName", "employer", "organization"), "location": ("location", "candidate_required_location", "job_location", "city", "place"),
    "salary": ("salary", "salary_range", "compensation", "pay", "salaryRange"), "employment_type": ("job_type", "employment_type", "type", "contract_type", "employmentType"),
    "remote_status": ("remote", "is_remote", "workplace_type", "remote_status", "workplaceType"), "industry": ("industry", "category", "department", "sector"),
    "published_at": ("publication_date", "published_at", "created_at", "posted_at", "date", "pubDate", "updated_at"),
}
LIMITS = {"source_job_id": 256, "title": 512, "description": 200_000, "company": 256, "location": 256, "salary": 256, "employment_type": 64, "remote_status": 64, "industry": 128}


def extract_path(payload: Column, path: str) -> Column:
    """A variant at a dotted path; number segments index lists, from the end if negative; null where nothing is."""
    at = payload
    for part in path.split("."):
        if part.lstrip("-").isdigit():
            index = int(part)
            items = F.try_variant_get(at, "$", "array<variant>")
            at = F.try_element_at(items, F.lit(index + 1 if index >= 0 else index))
        else:
            at = F.try_variant_get(at, f"$['{part}']", "variant")
    return at


def stringify(value: Column) -> Column:
    """Trimmed text of a scalar; a map's name, label, title, value or text; a list's parts with commas; null if empty."""
    scalar = lambda v: F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))
    kind = F.schema_of_variant(value)
    named = reduce(lambda a, b: F.coalesce(a, b), [scalar(F.try_variant_get(value, f"$.{k}", "variant")) for k in ("name", "label", "title", "value", "text")])
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), scalar)
    listed = F.nullif(F.array_join(F.filter(items, lambda s: s.isNotNull()), ", "), F.lit(""))
    return F.when(F.startswith(kind, F.lit("OBJECT")), named).when(F.startswith(kind, F.lit("ARRAY")), listed).when(kind == "VOID", None).otherwise(scalar(value))


def field(payload: Column, name: str, mapping: dict[str, str]) -> Column:
    declared = mapping.get(name)
    if declared is not None:
        return F.lit(declared[1:]) if declared.startswith("@") else stringify(extract_path(payload, declared))
    return F.coalesce(*[stringify(extract_path(payload, c)) for c in CANDIDATES[name]])


def to_raw(rows: DataFrame, source: str, kind: str, mapping: dict[str, str] | None = None, stem: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Raw records of rows (payload variant, file, row): id falls back to url, then to stem and row; no title, no record."""
    mapping, defaults = mapping or {}, defaults or {}
    unknown = set(mapping) - set(CANDIDATES)
    if unknown:
        raise ValueError(f"unknown mapping targets: {sorted(unknown)}")
    p = F.col("payload")
    out = rows.select("*", *[F.coalesce(field(p, name, mapping), F.lit(defaults.get(name))).alias(name) for name in CANDIDATES])
    fallback = F.concat_ws("-", F.lit(stem), F.col("row").cast("string")) if stem is not None else F.lit(None).cast("string")
    out = out.withColumn("source_job_id", F.coalesce("source_job_id", "url", fallback))
    clipped = [F.substring(c, 1, LIMITS[c]).alias(c) if c in LIMITS else F.col(c) for c in CANDIDATES if c != "published_at"]
    named = out.select(F.lit(source).alias("source"), F.lit(kind).alias("source_kind"), *clipped, dates.parse_datetime(F.col("published_at")).alias("published_at"), F.to_json("payload").alias("raw_payload"))
    return named.filter("title IS NOT NULL AND source_job_id IS NOT NULL")
