"""Record operators over strings that Spark renders from the tables, and streaming queries over the event file.

Each row of a table is written in one of several forms, which its key chooses; the SQL gives the values that were written,
so it shares nothing with the operator that reads them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions import dates, stats, text, urls
from tidemark.operators import dedup, maintenance, quality, records, skillmatch
from tidemark.plans.star import read, typed
from tidemark.streaming import jobs as streaming

ENTRIES: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = []

#: Keys and amounts of the orders, in the words of both engines.
ORDERS = "SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderpriority AS prio FROM orders"
CUSTOMERS = "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n, c_mktsegment AS seg, n_name AS land, r_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def given(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Result of ``sql`` over the tables of a folder."""
    names = [t for t in ("orders", "customer", "nation", "region", "events", "documents") if t in sql.split()]
    return spark.sql(" ".join("{" + w + "}" if w in names else w for w in sql.split()), **{t: read(spark, sf_dir, t) for t in names})


def rendered(name: str, base: str, forms: dict[str, str], make: Callable[..., list[Column]], outputs: list[str], expected: dict[str, str]) -> None:
    """``make`` over the strings ``forms`` of ``base``, against the values ``expected`` of the same rows in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = given(spark, sf_dir, base).select("k", *[F.expr(v).cast("string").alias(f"_{c}") for c, v in forms.items()])
        return typed(df.select("k", *[m.alias(o) for m, o in zip(make(*[F.col(f"_{c}") for c in forms]), outputs, strict=True)]))

    ENTRIES.append((name, run, f"SELECT k, {', '.join(f'{expected[o]} AS {o}' for o in outputs)} FROM ({base}) b"))


def parts(make: Callable[..., Column], *names: str) -> Callable[..., list[Column]]:
    return lambda *c: [make(*c)[n] for n in names]


def case(test: str, *values: str) -> str:
    """``values`` by the number that ``test`` gives; the last one for all others."""
    return f"CASE {test} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def grouped(x: str, mark: str) -> str:
    """A number from 1000 on with a mark before its last three digits."""
    return f"CAST(({x}) DIV 1000 AS STRING) || '{mark}' || lpad(CAST(({x}) % 1000 AS STRING), 3, '0')"


def double(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


LOW, HIGH, SMALL = "(20000 + p % 60000)", "(20001 + p % 60000 + k % 20000)", "(10 + p % 90)"
rendered(
    "salary_parse", ORDERS,
    {"raw": case("k % 9", f"{grouped(LOW, ',')} || ' - ' || {grouped(HIGH, ',')} || ' EUR per year'", f"'$' || {SMALL} || 'k - $' || ({SMALL} + 1 + k % 50) || 'k'", f"{grouped(LOW, '.')} || ' - ' || {grouped(HIGH, '.')} || ' EUR brutto/Jahr'", f"{SMALL} || ' USD/hour'",
        f"'PLN ' || {grouped(LOW, ' ')} || ' - ' || {grouped(HIGH, ' ')} || ' monthly'", "'Competitive salary'", "'Founded in ' || (1900 + p % 200)", "NULL", f"{SMALL} || ' USD per year'")},
    parts(records.salary, "min_amount", "max_amount", "currency", "period", "provenance"), ["min_amount", "max_amount", "currency", "period", "provenance"],
    {
        "min_amount": double(case("k % 9", LOW, f"{SMALL} * 1000", LOW, SMALL, LOW, "NULL")), "max_amount": double(case("k % 9", HIGH, f"({SMALL} + 1 + k % 50) * 1000", HIGH, "NULL", HIGH, "NULL")),
        "currency": case("k % 9", "'EUR'", "'USD'", "'EUR'", "'USD'", "'PLN'", "NULL"), "period": case("k % 9", "'yearly'", f"CASE WHEN {SMALL} < 15 THEN 'monthly' ELSE 'yearly' END", "'yearly'", "'hourly'", "'monthly'", "'unknown'"),
        "provenance": "CASE WHEN k % 9 < 5 THEN 'observed' ELSE 'unknown' END",
    },
)
rendered(
    "salary_convert", ORDERS, {"raw": f"{grouped(LOW, ',')} || {case('k % 4', repr(' EUR'), repr(' GBP'), repr(' USD'), repr(' PLN'))} || ' per month'"}, parts(records.salary, "annual_min", "normalized_currency"), ["annual_min", "normalized_currency"],
    {"annual_min": double(f"{LOW} * 12 * {case('k % 4', '1.09', '1.27', '1.0', '0.25')}"), "normalized_currency": "'USD'"},
)
rendered(
    "amount_parse", ORDERS,
    {"amount": case("k % 5", grouped(LOW, ","), grouped(LOW, "."), f"CAST({SMALL} AS STRING)", "(1 + p % 9) || '.' || (1 + k % 9)", f"{grouped(LOW, '.')} || ',' || lpad(CAST(k % 100 AS STRING), 2, '0')"), "suffix": case("k % 5", "NULL", "NULL", "'k'", "'M'", "NULL")},
    lambda a, b: [records.parse_amount(a, b)], ["value"], {"value": double(case("k % 5", LOW, LOW, f"{SMALL} * 1000", "((1 + p % 9) * 10 + 1 + k % 9) * 100000", f"{LOW} + (k % 100) / 100.0"))},
)
_FIRM = "upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) || ' Works ' || k"
rendered(
    "company_normalise", CUSTOMERS, {"raw": case("k % 8", f"{_FIRM} || ' GmbH'", f"upper({_FIRM} || ' GmbH')", f"{_FIRM} || ' Inc.'", f"{_FIRM} || ' (via TalentPartners)'", f"{_FIRM} || ' Holding GmbH & Co. KG'", _FIRM, f"'  ' || {_FIRM} || ',  Ltd. '", "NULL")},
    parts(records.company, "name", "slug"), ["name", "slug"],
    {"name": f"CASE WHEN k % 8 = 7 THEN 'Unknown' ELSE {_FIRM} || CASE WHEN k % 8 = 4 THEN ' Holding' ELSE '' END END", "slug": "CASE WHEN k % 8 = 7 THEN 'unknown' ELSE lower(seg) || '-works-' || k || CASE WHEN k % 8 = 4 THEN '-holding' ELSE '' END END"},
)
_ROLES = (("Data Engineer", "Data Engineer", "Data Engineering"), ("QA Automation Tester", "QA Engineer", "Quality Assurance"), ("Backend Python Developer", "Backend Engineer", "Backend Engineering"), ("Python Developer", "Software Engineer", "Software Engineering"),
    ("SRE", "DevOps Engineer", "DevOps"), ("iOS Developer", "Mobile Engineer", "Mobile Development"), ("Firmware Engineer", "Embedded Engineer", "Embedded Engineering"), ("Gardener", "Other", "Other"))
_GRADES = (("Senior ", "senior", "Senior "), ("Sr. ", "senior", "Senior "), ("jr ", "junior", "Junior "), ("Lead ", "lead", "Lead "), ("Staff ", "principal", "Principal "), ("", "unknown", ""), ("Head of ", "director", ""))
_role, _grade = (lambda i: case("p % 8", *[f"'{r[i]}'" for r in _ROLES])), (lambda i: case("k % 7", *[f"'{g[i]}'" for g in _GRADES]))
rendered(
    "title_rules", ORDERS, {"raw": f"{_grade(0)} || {_role(0)} || {case('k % 3', repr(' (m/f/d)'), repr(' - Remote'), repr(''))}"}, parts(records.title, "canonical", "family", "seniority"), ["canonical", "family", "seniority"],
    {"canonical": f"CASE WHEN p % 8 = 7 THEN 'Other' WHEN k % 7 = 6 THEN {_role(2)} || ' Director' ELSE {_grade(2)} || {_role(1)} END", "family": _role(2), "seniority": _grade(1)},
)
_PLACES = (("Berlin", "Germany", "Berlin", "DE"), ("Austin", "United States", "Texas", "US"), ("Paris", "France", "Ile-de-France", "FR"), ("London", "UK", "England", "GB"), ("Bengaluru", "India", "Karnataka", "IN"), ("Vienna", "Austria", "Vienna", "AT"))
_place = lambda i: case("k % 6", *[f"'{x[i]}'" for x in _PLACES])
rendered(
    "location_normalise", CUSTOMERS, {"raw": case("n % 5", f"{_place(0)} || ', ' || {_place(1)}", f"{_place(0)} || ' / Hybrid'", f"{_place(0)} || ' (Remote)'", f"upper({_place(1)}) || ', ' || {_place(0)}", _place(0))},
    parts(records.location, "city", "region", "country_code"), ["city", "region", "country_code"], {"city": _place(0), "region": _place(2), "country_code": _place(3)},
)
rendered(
    "remote_type", ORDERS, {"place": case("k % 5", "'Remote'", "'Berlin (Hybrid)'", "'On-site, Munich'", "'Berlin ' || k", "NULL"), "hint": case("p % 4", "NULL", "'true'", "'Hybrid'", "'no'")},
    lambda a, b: [records.remote_type(a, b, F.lit(None).cast("string"))], ["remote_type"], {"remote_type": case("p % 4", case("k % 5", "'remote'", "'hybrid'", "'onsite'", "'unknown'"), "'remote'", "'hybrid'", "'onsite'")},
)
rendered(
    "employment_type", ORDERS, {"raw": case("k % 5", "'Full-time'", "'Contract'", "'Teilzeit'", "'Permanent'", "NULL"), "title": case("p % 3", "'Internship no ' || k", "'Clerk no ' || k", "NULL")},
    lambda a, b: [records.employment_type(a, b, F.lit(None).cast("string"))[x] for x in ("type", "confidence")], ["employment_type", "confidence"],
    {"employment_type": case("k % 5", "'full_time'", "'contract'", "'part_time'", "'full_time'", case("p % 3", "'internship'", "'unknown'")), "confidence": double(case("k % 5", *["0.95"] * 4, case("p % 3", "0.75", "0")))},
)
_LEVEL = case("k % 5", "'senior'", "'junior'", "'lead'", "'unknown'", "'unknown'")
_STATED = "(p % 3 < 2)"
_DERIVED = "CASE WHEN k % 13 < 1 THEN 'entry' WHEN k % 13 < 3 THEN 'junior' WHEN k % 13 < 5 THEN 'mid' WHEN k % 13 < 9 THEN 'senior' ELSE 'principal' END"
_RANK = "list_position(['intern', 'entry', 'junior', 'mid', 'senior', 'lead', 'principal'], {})"
_AGREE = f"abs({_RANK.format(_LEVEL)} - {_RANK.format(_DERIVED)}) <= 1"
rendered(
    "experience_level", ORDERS, {"body": case("p % 3", "(k % 13) || '+ years'", "'at least ' || (k % 13) || ' years'", "'none'"), "level": _LEVEL},
    lambda a, b: [records.experience_level(b, records.experience_years(a)["years_min"])[x] for x in ("level", "confidence")], ["level", "confidence"],
    {"level": f"CASE WHEN {_STATED} AND ({_LEVEL} = 'unknown' OR NOT {_AGREE}) THEN {_DERIVED} ELSE {_LEVEL} END", "confidence": double(f"CASE WHEN {_STATED} THEN CASE WHEN {_LEVEL} = 'unknown' THEN 0.75 WHEN {_AGREE} THEN 0.9 ELSE 0.6 END WHEN {_LEVEL} = 'unknown' THEN 0 ELSE 0.55 END")},
)
_N, _M = "(1 + p % 20)", "(1 + p % 20 + k % 9)"
rendered(
    "experience_years_rules", ORDERS, {"body": case("k % 7", f"{_N} || '-' || {_M} || ' years of experience'", f"'at least ' || {_N} || ' years of experience'", f"'We ask for ' || {_N} || '+ years'", f"{_N} || ' years of professional experience'", f"{_N} || ' years ago'", "NULL", f"{_N} || ' bis ' || {_M} || ' Jahre'")},
    parts(records.experience_years, "years_min", "years_max"), ["years_min", "years_max"], {"years_min": double(case("k % 7", _N, _N, _N, _N, "NULL", "NULL", _N)), "years_max": double(case("k % 7", _M, *["NULL"] * 5, _M))},
)
rendered(
    "parse_datetime", "SELECT event_id AS k, CAST(ts AS TIMESTAMP) AS t FROM events",
    {"raw": case("k % 9", *[f"date_format(t, \"{f}\")" for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "MMMM d, yyyy")], "CAST(unix_seconds(t) AS STRING)", "CAST(unix_millis(t) AS STRING)", "'day ' || k")},
    lambda c: [F.date_format(dates.parse_datetime(c), "yyyy-MM-dd HH:mm")], ["moment"], {"moment": "CASE WHEN k % 9 = 8 THEN NULL WHEN k % 9 IN (3, 5) THEN strftime(t, '%Y-%m-%d 00:00') ELSE strftime(t, '%Y-%m-%d %H:%M') END"},
)
rendered(
    "html_and_mojibake", ORDERS, {"raw": case("k % 5", "'<div><p>' || prio || ' <b>' || k || '</b></p><script>alert(1)</script></div>'", "'<p>' || prio || '&nbsp;&amp;   ' || k || '</p>'", "'Weâ€™re ' || k", "'\\n ' || prio || '\\t\\n' || p || ' '", "NULL")},
    lambda c: [text.clean_text(text.repair_mojibake(c))], ["value"], {"value": case("k % 5", "prio || ' ' || k", "prio || ' & ' || k", "'We''re ' || k", "prio || ' ' || p", "''")},
)
rendered(
    "url_rules", ORDERS, {"raw": case("k % 4", "'HTTPS://WWW.Example.com:443/orders/' || k || '/?utm_source=x&b=' || p || '&a=1#frag'", "'shop' || k || '.example.com'", "'http://user@example.com:8080/' || k || '?REF=' || p", "NULL")},
    lambda c: [urls.normalize_url(c)], ["value"], {"value": case("k % 4", "'https://example.com/orders/' || k || '?a=1&b=' || p", "'https://shop' || k || '.example.com/'", "'http://example.com:8080/' || k", "''")},
)
rendered("contains_word", "SELECT doc_id AS k, text AS t FROM documents", {"raw": "t"}, lambda c: [text.contains_word(c, "the")], ["found"], {"found": "regexp_matches(lower(t), '(^|[^a-z0-9])the([^a-z0-9]|$)')"})
rendered(
    "location_display", CUSTOMERS, {"city": "CASE WHEN k % 5 < 2 THEN land END", "region": "CASE WHEN k % 5 IN (0, 2) THEN area END", "country": "CASE WHEN k % 5 IN (0, 1) THEN land END", "raw": "CASE WHEN k % 5 = 3 THEN ' place ' || k || ' ' END"},
    lambda a, b, c, d: [text.display_location(a, b, c, d)], ["value"], {"value": case("k % 5", "land || ', ' || area", "land", "area", "'place ' || k", "'Unknown'")},
)
rendered(
    "annual_midpoint", ORDERS, {"low": "CASE WHEN k % 4 <> 1 THEN p END", "high": "CASE WHEN k % 4 <> 2 THEN p + k END", "period": case("k % 7", *[f"'{x}'" for x in ("hourly", "daily", "weekly", "monthly", "yearly", "unknown")], "NULL")},
    lambda a, b, p: [stats.annualised(stats.midpoint(a.cast("double"), b.cast("double")), p)], ["value"], {"value": double(f"{case('k % 4', '(p + p + k) / 2.0', 'p + k', 'p', '(p + p + k) / 2.0')} * {case('k % 7', '2080', '260', '52', '12', '1', 'NULL')}")},
)
_SLUGS = ("python", "java", "rust", "typescript", "docker", "go")
_LISTED = "concat_ws(', ', " + ", ".join(f"CASE WHEN (k DIV {2**i}) % 2 = 1 THEN '{s.title()}' END" for i, s in enumerate(_SLUGS)) + ")"
rendered(
    "skill_extract", ORDERS, {"title": "'Order no ' || k", "body": f"CASE WHEN k % 64 > 0 THEN 'Stack: ' || {_LISTED} WHEN p % 2 = 1 THEN 'We go to the office daily.' ELSE 'After our Series C round we grow.' END"},
    lambda a, b: [F.array_join(F.array_sort(F.transform(skillmatch.top(skillmatch.extract(a, b), 60), lambda s: s["slug"])), ",")], ["slugs"],
    {"slugs": "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN (k // {2**i}) % 2 = 1 THEN '{s}' END" for i, s in enumerate(_SLUGS)) + "], lambda x: x IS NOT NULL)), ',')"},
)


def cascade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: every fifth carries the natural key and every third the page of the document five and three before it."""
    docs = read(spark, sf_dir, "documents")
    before = lambda step, name: F.when(F.col("doc_id") % step == 0, F.concat(F.lit(name), F.floor(F.col("doc_id") / (2 * step)))).otherwise(F.concat(F.lit(f"{name}of"), "doc_id"))
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), before(5, "key").alias("natural_key"), before(3, "url").alias("url_fingerprint"), F.md5("text").alias("content_hash"), "text")


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact part of the verdicts: natural key, then url, then content."""
    return dedup.exact_verdicts(cascade_records(spark, sf_dir).drop("text")).select("id", "kind", "duplicate_of")


def _before(step: int, name: str) -> str:
    return f"CASE WHEN doc_id % {step} = 0 THEN '{name}' || (doc_id // {2 * step}) ELSE '{name}of' || doc_id END"


_FIRSTS = f"SELECT id, min(id) OVER (PARTITION BY a) AS s, min(id) OVER (PARTITION BY b) AS u, min(id) OVER (PARTITION BY c) AS t FROM (SELECT doc_id AS id, {_before(5, 'key')} AS a, {_before(3, 'url')} AS b, md5(text) AS c FROM documents)"
ENTRIES.append(("dedup_cascade", _cascade, f"SELECT id, CASE WHEN s <> id THEN 'exact_source' WHEN u <> id THEN 'url' WHEN t <> id THEN 'content' END AS kind, CASE WHEN s <> id THEN s WHEN u <> id THEN u WHEN t <> id THEN t END AS duplicate_of FROM ({_FIRSTS})"))
#: MinHash has no SQL: a test holds these verdicts against brute force.
ENTRIES.append(("dedup_verdicts", lambda spark, sf_dir: typed(dedup.dedup(cascade_records(spark, sf_dir)).select("id", "kind", "duplicate_of", "score")), None))

#: Dimensions of an order priority's orders, in the words of both engines.
DIMS = """SELECT substr(o_orderpriority, 1, 1) AS source, avg(CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE 1e0 END) AS completeness, avg(CASE WHEN o_orderkey % 10 < CAST(substr(o_orderpriority, 1, 1) AS INT) THEN 0e0 ELSE 1e0 END) AS validity,
 avg(CASE WHEN o_custkey % 3 = 0 THEN 0e0 ELSE 1e0 END) AS uniqueness, avg(CASE WHEN o_totalprice > 400000 THEN 0e0 ELSE 1e0 END) AS consistency, avg(CASE WHEN o_custkey % 10 < 2 * CAST(substr(o_orderpriority, 1, 1) AS INT) THEN 0e0 ELSE 1e0 END) AS accuracy, avg(CASE WHEN o_orderkey % 5 < 3 THEN 0e0 ELSE 1e0 END) AS freshness FROM orders GROUP BY substr(o_orderpriority, 1, 1)"""
_WEIGHTS = {"completeness": "0.25", "validity": "0.20", "uniqueness": "0.15", "consistency": "0.15", "accuracy": "0.15", "freshness": "0.10"}
_LIMITS = {"completeness": "0.6", "validity": "0.9", "uniqueness": "0.7", "consistency": "0.8", "accuracy": "0.5", "freshness": "0.5"}
_dims = lambda spark, sf_dir: given(spark, sf_dir, DIMS).select("source", *[F.col(c).cast("double").alias(c) for c in _WEIGHTS])
ENTRIES.append((
    "quality_score_grade", lambda spark, sf_dir: typed(quality.graded(_dims(spark, sf_dir)).select("source", "score", "grade")),
    f"SELECT source, {double('score')} AS score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM (SELECT source, {' + '.join(f'{w} * {c}' for c, w in _WEIGHTS.items())} AS score FROM ({DIMS}) d) s",
))
ENTRIES.append((
    "quality_events", lambda spark, sf_dir: typed(quality.events(_dims(spark, sf_dir)).select("source", "dimension", "value", "severity")),
    " UNION ALL ".join(f"SELECT source, '{c}' AS dimension, {double(c)} AS value, CASE WHEN {c} >= 0.7 * {x} THEN 'warning' ELSE 'error' END AS severity FROM ({DIMS}) d WHERE {c} < {x}" for c, x in _LIMITS.items()),
))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _target(spark: SparkSession) -> str:
    return tables.fresh(spark, "stream")


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a day, streamed over the file and kept in complete mode."""
    counted = streaming.daily(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    out = _target(spark)
    streaming.run_once(counted, "", f"{out}/checkpoint", "complete", lambda df, i: df.write.mode("overwrite").parquet(f"{out}/data"))
    return typed(spark.read.parquet(f"{out}/data"))


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user and type, with state that is kept for 40 days."""
    found = streaming.distinct(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "ts", "40 days")
    out = _target(spark)
    streaming.run_once(found.select("user_id", "event_type"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.schema("user_id long, event_type string").parquet(f"{out}/data")


ENTRIES.append(("stream_daily_counts", _stream_daily, "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1"))
ENTRIES.append(("stream_dedup_watermark", _stream_dedup, "SELECT DISTINCT user_id, event_type FROM events"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows written twice: the later one stays."""
    daily = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    old, new = daily.withColumn("computed_at", F.lit(1)), daily.filter("day >= DATE'2024-01-15'").withColumn("n", F.col("n") * 2).withColumn("computed_at", F.lit(2))
    return typed(maintenance.upsert_latest(old, new, ["day"], "computed_at").drop("computed_at"))


ENTRIES.append(("snapshot_upsert", _snapshots, "SELECT ts::DATE AS day, count(*) * CASE WHEN ts::DATE >= DATE '2024-01-15' THEN 2 ELSE 1 END AS n FROM events GROUP BY ts::DATE"))


ENTRIES.append(("dedup_near_pairs", lambda spark, sf_dir: _near(spark, sf_dir), None))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate verdicts of distinct documents by the record deduplicator."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("text").agg(F.min("doc_id").alias("id"))
    signed = docs.select("id", F.col("id").alias("ord"), dedup.signature("text").alias("sig"))
    return dedup.near_pairs(signed).select("later", "earlier", "score")


