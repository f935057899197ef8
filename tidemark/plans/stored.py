"""Queries through stored structures: band index, versioned tables, text index, streams, bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.engine import Engine
from tidemark.filters import AnalyticsFilter
from tidemark.functions import text
from tidemark.operators import dedup, postings, quantiles, tree
from tidemark.operators.bandindex import BandIndex
from tidemark.operators.textindex import TextIndex
from tidemark.plans.star import read, typed
from tidemark.plans.texts import _TOKENS, key
from tidemark.sources import files

ENTRIES: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = []


def _rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document against the stored index of all: near documents by exact Jaccard, the best of them first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    signed = tables.stage(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), dedup.signature("text").alias("sig"), F.xxhash64("text").alias("class")), "signed")
    index = BandIndex.create(signed, tables.fresh(spark, "bands"))
    asked = signed.filter("id % 20 = 0")
    found = tables.stage(index.near(asked, 0.6), "near")  # well below 0.85, which the exact sets then decide
    members = index.members(found)
    firsts = docs.join(members.select(F.col("id").alias("doc_id"), "class"), "doc_id").select("class", "text")
    sets = tables.stage(firsts, "firsts").select("class", text.shingles(text.tokenize(F.col("text"))).alias("s"))
    both = found.join(sets, "class").join(sets.toDF("asked", "t"), "asked")
    exact = both.withColumn("jaccard", dedup.exact_jaccard(F.col("s"), F.col("t"))).filter("jaccard >= 0.85").select("asked", "class", "jaccard")
    near = asked.select("id", F.col("class").alias("asked")).join(exact, "asked").join(members.select("class", "n", F.col("id").alias("first")), "class")
    told = near.groupBy("id").agg((F.sum("n") - 1).cast("long").alias("n_near"), F.count("*").alias("n_classes"), F.min(F.when(F.col("asked") != F.col("class"), F.col("first"))).alias("other"))
    best = near.filter("asked <> class").groupBy("id").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))
    return told.join(best, "id", "left").select(F.col("id").alias("doc_id"), "n_near", "n_classes", "other", "jaccard")


ENTRIES.append(("rescan_index", _rescan, f"""WITH t AS (SELECT doc_id, text, {_TOKENS.format(x='text')} AS t FROM documents),
s AS (SELECT doc_id, text, CASE WHEN len(t) <= 5 THEN list_distinct(t) ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) END AS s FROM t),
c AS (SELECT text, min(doc_id) AS first, count(*) AS n, any_value(s) AS s, len(any_value(s)) AS size FROM s WHERE len(s) > 0 GROUP BY text),
x AS (SELECT first, size, unnest(s) AS w FROM c),
q AS (SELECT s.doc_id, c.first FROM s JOIN c USING (text) WHERE s.doc_id % 20 = 0),
p AS (SELECT a.first AS a, b.first AS b, count(*)::DOUBLE / (any_value(a.size) + any_value(b.size) - count(*)) AS jaccard FROM x a JOIN x b USING (w) WHERE a.first IN (SELECT first FROM q) GROUP BY 1, 2)
SELECT q.doc_id, (sum(c.n) - 1)::BIGINT AS n_near, count(*) AS n_classes, min(CASE WHEN p.b <> q.first THEN p.b END) AS other, round(max(CASE WHEN p.b <> q.first THEN jaccard END), 6) AS jaccard
FROM q JOIN p ON p.a = q.first JOIN c ON c.first = p.b WHERE jaccard >= 0.85 GROUP BY 1"""))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type after ten merges into a versioned table, three of them replayed or late."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    table = tables.KeyedTable.create(spark, tables.fresh(spark, "keyed"), events.schema, ["user_id", "event_type"], 8)
    slices = [events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k) for k in range(4)]
    order = F.struct("ts", "event_id")
    run = lambda df, i: table.merge(df.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("t")).agg(F.max_by(F.struct(*events.columns), order).alias("r")).select("r.*"), i, _last)
    for batch_id, k in [(0, 2), (1, 0), (1, 3), (2, 3), (3, 1), (3, 0), (4, 0)]:  # batch 1 and 3 are replayed with other rows, which have to be ignored; 4 repeats old rows
        run(slices[k], batch_id)
    table.vacuum()
    return table.read()


def _last(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new)
    return both.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("t")).agg(F.max_by(F.struct(*old.columns), F.struct("ts", "event_id")).alias("r")).select("r.*")


ENTRIES.append(("keyed_merge", _merged, "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"))


#: Words of the invented prose: one term, two, three.
SEARCHES = ("hation", "the of", "les aux que")


def _full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty documents of each search, through the stored inverted index."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex.create(docs, tables.fresh(spark, "text"), 16)
    found = [index.search(q, 20).select(F.lit(q).alias("query"), "place", F.col("id").alias("doc_id"), "score") for q in SEARCHES]
    return reduce(DataFrame.unionByName, found)


def _search_sql(query: str) -> str:
    words = sorted(query.split())
    listed = ", ".join(f"'{w}'" for w in words)
    if len(words) == 1:
        rank = f"SELECT doc_id, round(0.1 * list_sum(list_transform(range(1, count(*) + 1), lambda k: 1.0::DOUBLE / (k * k))) / 1.64493406685, 6) AS score FROM w WHERE term = '{words[0]}' GROUP BY doc_id"
    else:
        rank = f"""SELECT h.doc_id, round(1 - exp(coalesce(l, 0)), 6) AS score FROM (SELECT doc_id FROM w WHERE term IN ({listed}) GROUP BY doc_id HAVING count(DISTINCT term) = {len(words)}) h
        LEFT JOIN (SELECT a.doc_id, sum(ln(1 - 0.1 * sqrt(1.0::DOUBLE / (1.005 + 0.05 * exp(abs(a.at - b.at) / 1.5::DOUBLE - 2))))) AS l FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term < b.term AND abs(a.at - b.at) <= 100 WHERE a.term IN ({listed}) AND b.term IN ({listed}) GROUP BY 1) p ON h.doc_id = p.doc_id"""
    return f"SELECT '{query}' AS query, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS place, doc_id, score FROM ({rank}) QUALIFY place <= 20"


ENTRIES.append(("full_text_ranked", _full_text, f"WITH k AS (SELECT doc_id, list_filter(string_split({key('text')}, ' '), lambda t: t <> '') AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS at FROM k) " + " UNION ALL ".join(f"SELECT * FROM ({_search_sql(q)})" for q in SEARCHES)))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts, the brands of a type and the sizes of a brand as a tree, with the parts in each subtree."""
    brand, size = F.concat_ws(":", "p_type", "p_brand"), F.concat_ws(":", "p_type", "p_brand", "p_size")
    parts = read(spark, sf_dir, "part").select("p_type", brand.alias("brand"), size.alias("size"))
    pairs = [(F.lit("parts"), F.lit(None).cast("string")), (F.col("p_type"), F.lit("parts")), (F.col("brand"), F.col("p_type")), (F.col("size"), F.col("brand"))]
    closure = tree.closure(reduce(DataFrame.unionByName, [parts.select(c.alias("child"), p.alias("parent")).distinct() for c, p in pairs]))
    total = tree.subtree_sums(closure, parts.select(F.col("size").alias("node"), F.lit(1).alias("value")))
    return typed(tree.laid_out(closure).join(total, "node"))


ENTRIES.append(("taxonomy_tree", _tree, """WITH RECURSIVE p AS (SELECT p_type, p_type || ':' || p_brand AS brand, p_type || ':' || p_brand || ':' || p_size AS size FROM part),
e AS (SELECT 'parts' AS child, NULL AS parent UNION ALL SELECT DISTINCT p_type, 'parts' FROM p UNION ALL SELECT DISTINCT brand, p_type FROM p UNION ALL SELECT DISTINCT size, brand FROM p),
t AS (SELECT child AS node, child AS ancestor, 0 AS distance FROM e UNION ALL SELECT t.node, e.parent, t.distance + 1 FROM t JOIN e ON t.ancestor = e.child WHERE e.parent IS NOT NULL),
b AS (SELECT ancestor AS node, count(*) FILTER (distance > 0) AS n_below FROM t GROUP BY 1),
v AS (SELECT t.ancestor AS node, count(*) AS total FROM p JOIN t ON p.size = t.node GROUP BY 1)
SELECT t.node, max(distance)::BIGINT AS depth, string_agg(t.ancestor, '/' ORDER BY distance DESC) AS path, any_value(b.n_below) AS n_below, any_value(v.total) AS total FROM t JOIN b ON b.node = t.node JOIN v ON v.node = t.node GROUP BY t.node"""))


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the price of all lines by flag and status, by rank selection."""
    found = quantiles.exact(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), [0.01, 0.5, 0.99])
    return typed(found.select("l_returnflag", "l_linestatus", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("p01", "p50", "p99"))]))


ENTRIES.append(("exact_quantiles", _quantiles, "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {p}), 6) AS p{name}" for p, name in ((0.01, "01"), (0.5, "50"), (0.99, "99"))) + " FROM lineitem GROUP BY 1, 2"))


POSTED = datetime(2024, 6, 1)
TITLES = ("Senior Python Developer", "Data Engineer", "Backend Engineer", "Head of Engineering")
PLACES = (("Berlin, Germany", "no"), ("Austin, TX", "no"), ("Remote", "yes"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as raw postings (title, place, pay and day follow from the id), through cleaning to the columnar store and back."""
    n = F.col("doc_id")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))
    raw = read(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("none")).alias("source"), F.lit("dataset").alias("source_kind"), n.cast("string").alias("source_job_id"), F.concat(F.lit("https://example.com/jobs/"), n).alias("url"),
        pick(TITLES).alias("title"), F.col("text").alias("description"), F.concat(F.lit("Firm "), F.coalesce("source", F.lit("none"))).alias("company"), pick([p for p, _ in PLACES]).alias("location"), pick([r for _, r in PLACES]).alias("remote_status"),
        F.when(n % 5 != 0, F.concat((60 + n % 40).cast("string"), F.lit("k - "), (80 + n % 40).cast("string"), F.lit("k USD per year"))).alias("salary"), F.lit("Full-time").alias("employment_type"), F.lit(None).cast("string").alias("industry"),
        (F.lit(POSTED).cast("timestamp") - F.make_dt_interval(days=(n % 27 * 30).cast("int"))).alias("published_at"), F.lit(POSTED).cast("timestamp").alias("collected_at"),
    )
    root = tables.fresh(spark, "store")
    files.export(postings.from_raw(raw, POSTED)[0], root)
    return files.store(spark, root)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _postings(spark, sf_dir)
    kept = ["title_family", "company_name", "country", "remote_type", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_annual_max", "status", "year", "month", "day"]
    return typed(found.select(F.col("source_job_id").cast("long").alias("doc_id"), *kept))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's headline row over the store that was made from the documents."""
    jobs, bridge = postings.stored(_postings(spark, sf_dir))
    return typed(Engine(jobs, bridge).overview(AnalyticsFilter(as_of=POSTED, window_days=365)))


_VALID = r"""WITH d AS (SELECT doc_id, doc_id % 3 AS place, doc_id % 5 <> 0 AS paid, 60 + doc_id % 40 AS k, coalesce(source, 'none') AS source, (TIMESTAMP '2024-06-01' - to_days((doc_id % 27 * 30)::INT)) AS posted FROM documents
 WHERE length(trim(regexp_replace(text, '[ \t]+', ' ', 'g'))) >= 40 AND doc_id % 27 * 30 <= 730 AND NOT regexp_matches(text, '(?i)<\s*script|javascript:|vbscript:|<[a-z][^>]*\son[a-z]+\s*=')) """
ENTRIES.append(("records_flat", _flat, _VALID + """SELECT doc_id, ['Software Engineering', 'Data Engineering', 'Backend Engineering', 'Software Engineering'][doc_id % 4 + 1] AS title_family, 'Firm ' || source AS company_name, ['Germany', 'United States', NULL][place + 1] AS country,
 CASE WHEN place = 2 THEN 'remote' ELSE 'onsite' END AS remote_type, 'full_time' AS employment_type, CASE WHEN paid THEN k * 1000.0::DOUBLE END AS salary_min, CASE WHEN paid THEN (k + 20) * 1000.0::DOUBLE END AS salary_max, CASE WHEN paid THEN 'USD' END AS salary_currency,
 CASE WHEN paid THEN (k + 20) * 1000.0::DOUBLE END AS salary_annual_max, 'active' AS status, year(posted) AS year, month(posted) AS month, day(posted) AS day FROM d"""))
ENTRIES.append(("records_overview", _overview, _VALID + """, a AS (SELECT count(*) AS active_jobs, count(*) AS total_jobs, count(*) AS new_today, count(*) AS new_week, 0.0::DOUBLE AS freshness_hours FROM d),
b AS (SELECT count(DISTINCT source) AS companies, count(DISTINCT CASE WHEN place < 2 THEN place END) AS countries, round(coalesce(count(*) FILTER (place = 2) / nullif(count(*), 0), 0), 6) AS remote_share, count(*) FILTER (paid) AS samples, round(quantile_cont(CASE WHEN paid THEN (k + 10) * 1000.0::DOUBLE END, 0.5), 6) AS median_salary
 FROM d WHERE posted >= TIMESTAMP '2024-06-01' - INTERVAL 365 DAY) SELECT * FROM a, b"""))
