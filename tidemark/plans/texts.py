"""Scalar, record and event operators bound to documents, pages and events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators import dedup, quality, records, volume
from tidemark.plans.star import read, typed

ENTRIES: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = []
EVENTS_AS_OF = datetime(2024, 1, 31)


def entry(name: str, table: str, sql: str | None):
    def put(function: Callable[[DataFrame], DataFrame]):
        ENTRIES.append((name, lambda spark, sf_dir: typed(function(read(spark, sf_dir, table))), sql))
        return function

    return put


def column(make) -> Callable[[DataFrame], DataFrame]:
    """doc_id and one expression of the text."""
    return lambda d: d.select("doc_id", make(F.col("text")).alias("value"))


# pieces of SQL for the functions, over an expression {x}
_KEY = "trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '\\p{{M}}+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = r"list_filter(list_transform(regexp_extract_all(regexp_replace(lower({x}), 'https?://\S+', ' ', 'g'), '[a-z0-9][a-z0-9+#.\-_/]*'), lambda t: regexp_replace(t, '^[._\-/]+|[._\-/]+$', '', 'g')), lambda t: t <> '')"


def key(x: str) -> str:
    return _KEY.format(x=x)


entry("canonical_key", "documents", f"SELECT doc_id, {key('text')} AS value FROM documents")(column(text.canonical_key))
entry("slugify", "documents", f"SELECT doc_id, regexp_replace(substr(replace({key('text')}, ' ', '-'), 1, 80), '-+$', '') AS value FROM documents")(column(text.slugify))
entry("tokenize_counts", "documents", f"SELECT doc_id, len({_TOKENS.format(x='text')})::BIGINT AS value FROM documents")(column(lambda c: F.size(text.tokenize(c))))
entry("distinct_tokens", "documents", f"SELECT doc_id, len(list_distinct({_TOKENS.format(x='text')}))::BIGINT AS value FROM documents")(column(lambda c: F.size(F.array_distinct(text.tokenize(c)))))
entry("collapse_whitespace", "documents", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS value FROM documents")(column(text.collapse))
entry("truncate_snippet", "documents", "SELECT doc_id, CASE WHEN length(text) > 480 THEN rtrim(substr(text, 1, 477)) || '...' ELSE text END AS value FROM documents")(column(lambda c: text.truncate(c, 480)))
entry("remove_urls", "documents", r"SELECT doc_id, md5(regexp_replace(text, '(?i)https?://\S+', ' ', 'g')) AS value FROM documents")(column(lambda c: F.md5(text.remove_urls(c))))
entry("null_tokens", "documents", "SELECT source AS source, count(*) AS n, count(*) FILTER (lower(trim(lang)) IN ('en', 'n/a', 'unknown', '')) AS blank FROM (SELECT source, CASE lang WHEN 'de' THEN ' N/A ' WHEN 'fr' THEN 'Unknown' WHEN 'es' THEN '' ELSE 'x' END AS lang FROM documents) GROUP BY 1")(
    lambda d: d.select("source", F.when(F.col("lang") == "de", " N/A ").when(F.col("lang") == "fr", "Unknown").when(F.col("lang") == "es", "").otherwise("x").alias("lang")).groupBy("source").agg(F.count("*").alias("n"), F.count_if(text.is_null_token(F.col("lang"))).alias("blank"))
)
entry("content_fingerprint", "documents", f"SELECT doc_id, sha256({key('source')} || chr(0) || {key('lang')} || chr(0) || '' || chr(0) || {key('substr(text, 1, 4000)')}) AS value FROM documents")(
    lambda d: d.select("doc_id", urls.sha_parts(text.canonical_key(F.col("source")), text.canonical_key(F.col("lang")), F.lit(None).cast("string"), text.canonical_key(F.substring("text", 1, 4000))).alias("value"))
)
entry("hash_tokens", "documents", f"SELECT doc_id, sha256(array_to_string(list_sort(list_distinct({_TOKENS.format(x='text')})), chr(0))) AS value FROM documents")(column(lambda c: urls.hash_tokens(text.tokenize(c))))
entry("shingle_counts", "documents", f"SELECT doc_id, len(CASE WHEN len(t) <= 5 THEN list_distinct(t) ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END)::BIGINT AS value FROM (SELECT doc_id, {_TOKENS.format(x='text')} AS t FROM documents)")(column(lambda c: F.size(text.shingles(text.tokenize(c)))))
entry("language_detect", "documents", None)(lambda d: d.select("doc_id", records.language(F.col("text")).alias("l")).select("doc_id", "l.code", "l.confidence"))
entry("experience_years", "documents", None)(lambda d: d.select("doc_id", records.experience_years(F.col("text")).alias("y")).select("doc_id", "y.years_min", "y.years_max"))
entry("tidy_description", "documents", None)(column(lambda c: F.md5(text.tidy_description(c))))

entry("strip_html_text", "pages", None)(lambda d: d.select("page_id", F.md5(text.clean_text(F.col("html"), True)).alias("value")))
_URL = r"""SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') ||
 CASE WHEN length(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)) > 1 THEN regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') ELSE '/' END AS head,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: regexp_matches(q, '^[^=]+=.+$') AND NOT list_contains(['utm_source', 'ref'], lower(split_part(q, '=', 1))))), '&') AS query FROM pages"""
entry("normalize_url", "pages", f"SELECT page_id, head || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS value FROM ({_URL})")(lambda d: d.select("page_id", urls.normalize_url(F.col("url")).alias("value")))
entry("url_fingerprint", "pages", f"SELECT page_id, sha256('url' || chr(0) || head || CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS value FROM ({_URL})")(lambda d: d.select("page_id", urls.url_fingerprint(F.col("url")).alias("value")))

entry("dedup_exact_content", "documents", "SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents)")(
    lambda d: dedup.exact_verdicts(d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("natural_key"), F.lit(None).cast("string").alias("url_fingerprint"), F.md5("text").alias("content_hash"))).select(F.col("id").alias("doc_id"), "duplicate_of")
)
entry("validate_reasons", "documents", r"""SELECT CASE WHEN trim(text) = '' THEN 'missing_required_field' WHEN length(trim(text)) < 40 THEN 'description_too_short' WHEN regexp_matches(text, '(?i)<\s*script|javascript:\s*|on(?:error|load|click)\s*=') THEN 'unsafe_content'
 WHEN DATE '2024-06-01' - (DATE '2024-06-01' - (doc_id % 1000)::INT) > 730 THEN 'stale_posting' END AS reason, count(*) AS n FROM documents GROUP BY 1""")(
    lambda d: d.select("text", F.concat(F.lit("title "), "source").alias("title"), F.col("text").alias("description"), (F.lit("2024-06-01").cast("timestamp") - F.make_dt_interval(days=(F.col("doc_id") % 1000).cast("int"))).alias("published_at")).select(records.rejection(datetime(2024, 6, 1)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
)
entry("quality_labels_fields", "documents", "SELECT 'lang' AS field, count(lang) AS present, count(*) - count(lang) AS missing FROM documents UNION ALL SELECT 'source', count(source), count(*) - count(source) FROM documents")(lambda d: quality.fields(d, ["lang", "source"]))


def _events(d: DataFrame) -> DataFrame:
    return d.select(F.col("event_id").alias("id"), dates.utc(F.col("ts")).alias("e"), "user_id", "event_type", "value", "props")


entry("event_daily_volume", "events", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")(lambda d: volume.daily(_events(d)))
entry("event_dense_ma7", "events", """WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), x AS (SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day))
SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma, (sum(n) OVER ())::BIGINT AS total, round(avg(n) OVER (), 6) AS mean FROM x""")(lambda d: volume.dense(_events(d).filter("event_type = 'purchase'"), "2024-01-01", "2024-01-31"))
entry("event_json_field", "events", "SELECT event_type, count(*) AS n, max((props->>'k')::BIGINT) AS top FROM events GROUP BY 1")(lambda d: _events(d).groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("top")))
entry("event_age_days", "events", "SELECT floor(epoch(TIMESTAMP '2024-01-31' - ts) / 86400)::BIGINT AS age, count(*) AS n FROM events GROUP BY 1")(lambda d: _events(d).groupBy(dates.age_days(F.col("e"), F.lit(EVENTS_AS_OF)).alias("age")).agg(F.count("*").alias("n")))
