"""Canonical URLs and fingerprints as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text

# Query parameters that never change what a URL points at.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid",
    "ref", "referrer", "source", "trk", "trkinfo", "position", "pageNum", "sessionid", "sid",
)
NUL = "\u0000"


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no www, default port, fragment, tracking parameters or trailing slash; sorted query."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    part = lambda k: F.regexp_extract(full, r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    scheme, authority, path, query = F.lower(part(1)), F.lower(F.regexp_replace(part(2), "^[^@]*@", "")), part(3), part(4)
    host = F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"^www\.", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when(default, host).otherwise(F.concat(host, F.lit(":"), port))
    path = F.when(path == "", "/").when(F.char_length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    name = lambda item: F.substring_index(item, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda q: F.rlike(q, F.lit("^[^=]+=.+$")) & ~F.lower(name(q)).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(raw == "", "").otherwise(F.concat(scheme, F.lit("://"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def sha_parts(*parts: Column) -> Column:
    """SHA-256 over the parts with a zero byte between them; null parts are empty."""
    return F.sha2(F.concat_ws(NUL, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(sha_parts(*parts), 1, length)


def url_fingerprint(c: Column) -> Column:
    url = normalize_url(c)
    return F.when(url == "", "").otherwise(sha_parts(F.lit("url"), url))


def content_fingerprint(company: Column, title: Column, location: Column, description: Column, chars: int = 4000) -> Column:
    key = text.canonical_key
    return sha_parts(key(company), key(title), key(location), key(F.substring(text.clean_text(description), 1, chars)))


def source_fingerprint(source: Column, source_id: Column) -> Column:
    return sha_parts(source, source_id)


def hash_tokens(tokens: Column) -> Column:
    """Independent of order and repetition."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens)), NUL), 256)


def stable_bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets))
