"""The model's roles bound to the order tables: orders are postings, brands of their lines are skills.

Each entry of ``ENTRIES`` is (name, query, SQL). Whole numbers are longs on both sides; doubles are rounded
to six digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.filters import AnalyticsFilter, live
from tidemark.operators import alerts, association, distribution, maintenance, market, quality, salary, search, skills, trends, volume

AS_OF = datetime(2001, 8, 2)
DAY = date(2001, 8, 2)
WINDOW = 365
OWNED = ["Brand#11", "Brand#23", "Brand#35", "Brand#44"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    people = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = t("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    e = F.col("o_orderdate").cast("timestamp")
    return wide.select(
        F.col("o_orderkey").alias("id"), e.alias("e"), e.alias("first_seen_at"), e.alias("published_at"),
        F.when(F.col("o_orderstatus") == "F", "expired").otherwise("active").alias("status"), F.lit(None).cast("long").alias("duplicate_of"),
        F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country"), F.col("n_name").alias("country_code"),
        F.col("r_name").alias("region"), F.concat_ws("/", "r_name", "n_name").alias("city"), F.col("o_orderpriority").alias("remote_type"), F.col("o_orderpriority").alias("experience_level"),
        F.col("o_orderstatus").alias("employment_type"), F.substring("o_orderpriority", 1, 1).alias("source"), F.col("o_totalprice").alias("salary_mid"),
        F.col("o_totalprice").alias("salary_annual_min"), F.lit(None).cast("double").alias("salary_annual_max"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "observed").otherwise("unknown").alias("salary_provenance"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, slug, confidence), unique by job and slug."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("job_id"), F.col("p_brand").alias("slug")).agg(F.max("l_discount").alias("confidence"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, name, category): brands with even last digit have no entry, so the fallbacks show."""
    found = read(spark, sf_dir, "part").select(F.col("p_brand").alias("slug")).distinct()
    return found.filter(F.substring("slug", -1, 1).isin("1", "3", "5")).select("slug", F.upper("slug").alias("name"), F.concat(F.lit("group "), F.substring("slug", 7, 1)).alias("category"))


def remote() -> Column:
    return F.col("remote_type") == "1-URGENT"


class Frame:
    """The tables of one question: everything, live, live in the window, and the bridge."""

    def __init__(self, spark: SparkSession, sf_dir: str, **filters) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.all = jobs(spark, sf_dir)
        self.live = self.all.filter(live())
        self.bridge = bridge(spark, sf_dir)
        self.filter = AnalyticsFilter(as_of=AS_OF, window_days=WINDOW, **filters)
        self.window = self.filter.apply(self.all, self.bridge)
        self.skills = dimension(spark, sf_dir)


def typed(df: DataFrame) -> DataFrame:
    kinds = {"int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, 6), "float": lambda c: F.round(F.col(c).cast("double"), 6)}
    return df.select(*[kinds.get(k, F.col)(c).alias(c) for c, k in df.dtypes])


P = """WITH jobs AS (SELECT o_orderkey AS id, o_orderdate AS e, CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'active' END AS status, c_name AS company, c_mktsegment AS segment,
  n_name AS country, r_name AS region, r_name || '/' || n_name AS city, o_orderpriority AS prio, o_orderstatus AS kind, substr(o_orderpriority, 1, 1) AS source, o_totalprice AS pay, o_orderpriority <> '4-NOT SPECIFIED' AS seen, o_orderpriority = '1-URGENT' AS remote
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
live AS (SELECT * FROM jobs WHERE status = 'active'),
win AS (SELECT * FROM live WHERE e >= TIMESTAMP '2000-08-02'),
bridge AS (SELECT l_orderkey AS job_id, p_brand AS slug, max(l_discount) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
met AS (SELECT win.*, slug, confidence FROM win JOIN bridge ON job_id = id),
lmet AS (SELECT live.*, slug FROM live JOIN bridge ON job_id = id),
total AS (SELECT count(DISTINCT id) AS total FROM met),
single AS (SELECT slug, count(*) AS n, avg(confidence) AS confidence FROM met GROUP BY 1),
dim AS (SELECT DISTINCT p_brand AS slug, upper(p_brand) AS name, 'group ' || substr(p_brand, 7, 1) AS category FROM part WHERE right(p_brand, 1) IN ('1', '3', '5'))
"""

ENTRIES: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = []


def entry(name: str, sql: str | None, **filters):
    """Register a query over a Frame and its SQL, which follows the shared WITH."""

    def put(function: Callable[[Frame], DataFrame]):
        ENTRIES.append((name, lambda spark, sf_dir: typed(function(Frame(spark, sf_dir, **filters))), None if sql is None else P + sql))
        return function

    return put


entry("daily_volume", "SELECT e::DATE AS day, count(*) AS n FROM win GROUP BY 1")(lambda f: volume.daily(f.window))
entry("daily_volume_since", "SELECT e::DATE AS day, count(*) AS n FROM jobs WHERE e::DATE >= DATE '2001-01-01' GROUP BY 1")(lambda f: volume.daily(f.all.filter(F.to_date("e") >= F.lit("2001-01-01").cast("date"))))
entry("volume_dense_ma7", """, d AS (SELECT unnest(generate_series(DATE '2000-08-02', DATE '2001-08-02', INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT e::DATE AS day, count(*) AS n FROM win GROUP BY 1), x AS (SELECT d.day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day))
SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma, (sum(n) OVER ())::BIGINT AS total, round(avg(n) OVER (), 6) AS mean FROM x""")(lambda f: volume.dense(f.window, "2000-08-02", "2001-08-02"))
entry("monthly_skill_matrix", "SELECT year(e) AS year, month(e) AS month, slug, count(*) AS n FROM lmet WHERE slug IN ('Brand#11', 'Brand#23', 'Brand#35', 'Brand#44') GROUP BY 1, 2, 3 ORDER BY 1 DESC, 2 DESC, 4 DESC, 3 LIMIT 48")(lambda f: volume.monthly_matrix(f.live, f.bridge, OWNED))
entry("dataset_describe", "SELECT count(*) AS rows, min(e)::DATE AS first_day, max(e)::DATE AS last_day FROM jobs")(lambda f: volume.describe(f.all))

entry("skill_demand", "SELECT slug, count(*) AS n FROM lmet GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")(lambda f: skills.counts(f.live, f.bridge, limit=25).select("slug", "n"))
entry("skill_demand_ranked_share", """SELECT s.slug, coalesce(name, s.slug) AS name, coalesce(category, 'other') AS category, n, row_number() OVER (ORDER BY n DESC, s.slug) AS rank, round(n / total, 6) AS share, round(confidence, 6) AS confidence
FROM single s LEFT JOIN dim USING (slug), total ORDER BY n DESC, s.slug LIMIT 10""")(lambda f: skills.demand(f.window, f.bridge, f.skills, 10))
entry("skill_counts_windows", """SELECT slug, count(*) FILTER (e >= TIMESTAMP '2000-08-02' AND e < TIMESTAMP '2001-08-02') AS current, count(*) FILTER (e >= TIMESTAMP '1999-08-03' AND e < TIMESTAMP '2000-08-02') AS previous FROM lmet
WHERE e >= TIMESTAMP '1999-08-03' AND e < TIMESTAMP '2001-08-02' GROUP BY 1""")(lambda f: skills.windows(f.live, f.bridge, (datetime(2000, 8, 2), AS_OF), (datetime(1999, 8, 3), datetime(2000, 8, 2))))
entry("skill_daily", "SELECT slug, e::DATE AS day, count(*) AS n FROM met GROUP BY 1, 2")(lambda f: skills.daily(f.window, f.bridge))
entry("skills_all_of", "SELECT id FROM met WHERE slug IN ('Brand#11', 'Brand#23') GROUP BY 1 HAVING count(*) = 2")(lambda f: skills.all_of(f.window, f.bridge, OWNED[:2]).select("id"))
entry("skills_any_of", "SELECT DISTINCT id FROM met WHERE slug IN ('Brand#11', 'Brand#23')")(lambda f: skills.any_of(f.window, f.bridge, OWNED[:2]).select("id"))
entry("jobs_with_skill", "SELECT total AS n FROM total")(lambda f: skills.with_skill(f.window, f.bridge))
entry("skill_filter_semijoin", "SELECT count(*) AS n, count(DISTINCT company) AS companies FROM met WHERE slug = 'Brand#23' AND segment = 'BUILDING'", skill="Brand#23", segment="BUILDING")(lambda f: f.window.agg(F.count("*").alias("n"), F.count_distinct("company_name").alias("companies")))
entry("similar_records", """, own AS (SELECT slug FROM bridge WHERE job_id = (SELECT min(job_id) FROM bridge) ORDER BY 1 LIMIT 6)
SELECT id, e FROM live WHERE id <> (SELECT min(job_id) FROM bridge) AND id IN (SELECT job_id FROM bridge JOIN own USING (slug)) ORDER BY e DESC, id LIMIT 5""")(lambda f: skills.similar(f.live, f.bridge, f.bridge.agg(F.min("job_id")).first()[0]).select("id", F.col("e").cast("timestamp_ntz").alias("e")))

_PAIRS = """, pair AS (SELECT a.slug AS skill_a, b.slug AS skill_b, count(*) AS n FROM met a JOIN met b ON a.id = b.id AND b.slug > a.slug GROUP BY 1, 2),
lifted AS (SELECT skill_a, skill_b, p.n, p.n / total AS support, p.n / a.n AS ab, p.n / b.n AS ba, (p.n / total) / ((a.n / total) * (b.n / total)) AS lift FROM pair p JOIN single a ON a.slug = skill_a JOIN single b ON b.slug = skill_b, total),
scored AS (SELECT *, round(ln(1 + lift) * sqrt(support), 9) AS association FROM lifted WHERE support >= 0.005)
"""
entry("skill_pairs", _PAIRS + "SELECT skill_a, skill_b, n FROM pair WHERE n >= 2")(lambda f: association.pairs(f.window, f.bridge))
entry("cooccurrence_lift", _PAIRS + "SELECT skill_a, skill_b, n, round(support, 6) AS support, round(ab, 6) AS confidence_ab, round(ba, 6) AS confidence_ba, round(lift, 6) AS lift, round(association, 6) AS association FROM scored WHERE n >= 3 ORDER BY scored.association DESC, skill_a, skill_b LIMIT 50")(lambda f: association.cooccurrence(f.window, f.bridge))
entry("related_skills", _PAIRS + "SELECT CASE WHEN skill_a = 'Brand#23' THEN skill_b ELSE skill_a END AS slug, n, round(support, 6) AS support, round(lift, 6) AS lift, round(association, 6) AS association FROM scored WHERE n >= 2 AND (skill_a = 'Brand#23' OR skill_b = 'Brand#23') ORDER BY scored.association DESC, skill_a, skill_b LIMIT 10")(lambda f: association.related(f.window, f.bridge, "Brand#23"))
entry("skill_graph_edges", _PAIRS + ", node AS (SELECT slug FROM single ORDER BY n DESC, slug LIMIT 8), top AS (SELECT * FROM scored WHERE n >= 2 ORDER BY association DESC, skill_a, skill_b LIMIT 32) SELECT skill_a, skill_b, n, round(association, 6) AS association FROM top WHERE skill_a IN (FROM node) AND skill_b IN (FROM node)")(lambda f: association.graph(f.window, f.bridge, 8)[1].select("skill_a", "skill_b", "n", "association"))

_TREND = """, s AS (SELECT slug, date_diff('day', e::DATE, DATE '2001-08-02') AS back, count(*) AS n FROM lmet WHERE e::DATE >= DATE '2001-08-02' - 1460 AND e::DATE <= DATE '2001-08-02' GROUP BY 1, 2),
w AS (SELECT unnest([90, 365, 730]) AS days),
k AS (SELECT slug, days, coalesce(sum(n) FILTER (back < days), 0)::BIGINT AS current, coalesce(sum(n) FILTER (back >= days AND back < 2 * days), 0)::BIGINT AS previous, count(*) FILTER (back < days) AS points,
  coalesce(sum(n) FILTER (back < days), 0)::DOUBLE / days AS mean, coalesce(sum(n * n) FILTER (back < days), 0)::DOUBLE / days AS square FROM s, w GROUP BY 1, 2),
t AS (SELECT slug, days, current, previous, points, CASE WHEN previous > 0 THEN 100.0::DOUBLE * (current - previous) / previous END AS change, CASE WHEN mean > 0 THEN sqrt(greatest(0, square - mean * mean)) / mean ELSE 0 END AS cv FROM k),
r AS (SELECT *, CASE WHEN change IS NULL OR points < 5 THEN 'insufficient_data' WHEN cv > 0.6 AND abs(change) < 30 THEN 'volatile' WHEN change >= 10 THEN 'rising' WHEN change <= -10 THEN 'declining' ELSE 'stable' END AS direction FROM t)
"""
WINDOWS = (90, 365, 730)
entry("skill_trend_windows", _TREND + "SELECT slug, days::BIGINT AS days, current, previous, round(change, 6) AS change, round(cv, 6) AS cv, direction FROM r")(lambda f: trends.windows(f.live, f.bridge, DAY, WINDOWS))
entry("skill_trend_headline", _TREND + "SELECT slug, days::BIGINT AS days, current, previous, round(change, 6) AS change, direction FROM r WHERE days = 730")(lambda f: trends.headline(trends.windows(f.live, f.bridge, DAY, WINDOWS)))
entry("skill_trend_summary", _TREND + ", z AS (SELECT slug, sum(n)::BIGINT AS sample, sum(n)::DOUBLE / 1461 AS mean, sum(n * n)::DOUBLE / 1461 AS square, coalesce(sum(n) FILTER (back < 7), 0)::DOUBLE / 7 AS ma FROM s GROUP BY 1) SELECT slug, sample, round(sqrt(greatest(0, square - mean * mean)) / mean, 6) AS volatility, round(ma, 6) AS moving_average, round(least(1, ln(1 + sample) / ln(51)), 6) AS confidence FROM z")(lambda f: trends.summary(f.live, f.bridge, DAY, WINDOWS))
entry("top_trends", _TREND + ", dem AS (SELECT slug, count(*) AS demand FROM met GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) SELECT slug, days::BIGINT AS days, current, previous, round(change, 6) AS change, direction, demand FROM r JOIN dem USING (slug) WHERE days = 730 ORDER BY demand DESC, slug LIMIT 10")(lambda f: trends.top(f.live, f.bridge, DAY, WINDOWS, window=f.window))
entry("fastest_growing", _TREND + "SELECT slug, days::BIGINT AS days, current, previous, round(change, 6) AS change, round(cv, 6) AS cv, direction FROM r WHERE days = 365 AND current >= 5 AND change IS NOT NULL AND slug IN (SELECT slug FROM single ORDER BY n DESC, slug LIMIT 40) ORDER BY r.change DESC, slug LIMIT 5")(lambda f: trends.fastest(f.live, f.bridge, DAY, 365, window=f.window))
entry("linear_slope", "SELECT slug, round(coalesce(CASE WHEN count(*) >= 2 THEN regr_slope(n, i) END, 0), 6) AS slope FROM (SELECT slug, n, row_number() OVER (PARTITION BY slug ORDER BY day) - 1 AS i FROM (SELECT slug, e::DATE AS day, count(*) AS n FROM met GROUP BY 1, 2)) GROUP BY 1")(lambda f: _slopes(f))


def _slopes(f: Frame) -> DataFrame:
    from pyspark.sql import Window

    from tidemark.functions import stats

    series = skills.daily(f.window, f.bridge).withColumn("i", F.row_number().over(Window.partitionBy("slug").orderBy("day")) - 1)
    return series.groupBy("slug").agg(stats.slope("n", "i").alias("slope"))


entry("emerging_skills", """, u AS (SELECT slug || '/' || segment AS slug, e, company FROM lmet), c AS (SELECT slug || '/' || company AS slug, count(*) FILTER (e >= TIMESTAMP '2000-08-02' AND e < TIMESTAMP '2001-08-02') AS current, count(*) FILTER (e >= TIMESTAMP '1999-08-03' AND e < TIMESTAMP '2000-08-02') AS previous FROM lmet WHERE e >= TIMESTAMP '1999-08-03' AND e < TIMESTAMP '2001-08-02' GROUP BY 1),
g AS (SELECT *, CASE WHEN previous > 0 THEN 100.0::DOUBLE * (current - previous) / previous END AS growth, greatest(sum(current) OVER (), 1)::BIGINT AS tc, greatest(sum(previous) OVER (), 1)::BIGINT AS tp FROM c),
q AS (SELECT *, CASE WHEN count(growth) OVER () >= 2 THEN (growth - avg(growth) OVER ()) / nullif(stddev_pop(growth) OVER (), 0) END AS z FROM g),
v AS (SELECT slug, current, previous, growth, previous / tp AS base, CASE WHEN growth IS NOT NULL THEN z END AS z, round(CASE WHEN growth IS NULL THEN 0.8::DOUBLE * least(1, ln(1 + current) / ln(31)) ELSE (0.4::DOUBLE * least(1, ln(1 + current) / ln(41)) + 0.3::DOUBLE * least(1, growth / 300) + 0.3::DOUBLE * least(1, greatest(0, coalesce(z, 0) / 4))) * greatest(0.3::DOUBLE, greatest(0, 1 - 10 * (current / tc))) END, 4) AS confidence
FROM q WHERE current >= 3 AND previous / tp <= 0.01 AND (growth IS NULL OR (growth >= 100 AND (z IS NULL OR z >= 2))))
SELECT slug, current, previous, round(growth, 6) AS growth, round(base, 6) AS baseline_share, round(z, 6) AS z, round(confidence, 6) AS confidence FROM v ORDER BY v.confidence DESC, current DESC, slug LIMIT 10""")(lambda f: trends.emerging(f.live, _pair_bridge(f), AS_OF, WINDOW, least=3))


def _pair_bridge(f: Frame) -> DataFrame:
    """Brand beside company as the skill, for many small series."""
    return f.bridge.join(f.live.select(F.col("id").alias("job_id"), "company_name"), "job_id").select("job_id", F.concat_ws("/", "slug", "company_name").alias("slug"), "confidence")


for _name, _column, _sql in (("remote_counts", "remote_type", "prio"), ("segment_counts", "segment", "segment"), ("employment_counts", "employment_type", "kind"), ("source_counts", "source", "source"), ("region_counts", "region", "region")):
    entry(_name, f"SELECT {_sql} AS value, count(*) AS n FROM win GROUP BY 1")(lambda f, c=_column: distribution.one(f.window, c))
entry("distributions_one_pass", "SELECT 'segment' AS dimension, segment AS value, count(*) AS n FROM win GROUP BY 2 UNION ALL SELECT 'remote_type', prio, count(*) FROM win GROUP BY 2 UNION ALL SELECT 'employment_type', kind, count(*) FROM win GROUP BY 2")(lambda f: distribution.many(f.window, ["segment", "remote_type", "employment_type"]))
entry("facets_topk", """, f AS (SELECT 'segment' AS dimension, segment AS value, count(*) AS n FROM live GROUP BY 2 UNION ALL SELECT 'country', country, count(*) FROM live GROUP BY 2 UNION ALL SELECT 'company_name', company, count(*) FROM live GROUP BY 2 UNION ALL SELECT 'skill', slug, count(*) FROM lmet GROUP BY 2),
g AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM f) SELECT dimension, value, n, rank FROM g WHERE rank <= CASE WHEN dimension = 'skill' THEN 12 ELSE 10 END""")(lambda f: distribution.facets(f.live, ["segment", "country", "company_name"], f.bridge, 10, 12))
entry("seniority_zero_filled", """, v AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS value), c AS (SELECT prio AS value, count(*) AS n FROM win GROUP BY 1), j AS (SELECT value, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (value))
SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM j""")(lambda f: distribution.zero_filled(f.window, "experience_level", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]))
entry("remote_change", """, x AS (SELECT count(*) FILTER (e >= TIMESTAMP '2000-08-02' AND e <= TIMESTAMP '2001-08-02' AND remote) AS a, count(*) FILTER (e >= TIMESTAMP '2000-08-02' AND e <= TIMESTAMP '2001-08-02') AS b, count(*) FILTER (e >= TIMESTAMP '1999-08-03' AND e <= TIMESTAMP '2000-08-02' AND remote) AS c, count(*) FILTER (e >= TIMESTAMP '1999-08-03' AND e <= TIMESTAMP '2000-08-02') AS d FROM live)
SELECT round(a / nullif(b, 0), 6) AS current_share, round(c / nullif(d, 0), 6) AS previous_share, round(100 * ((a / nullif(b, 0)) - (c / nullif(d, 0))) / nullif(c / nullif(d, 0), 0), 6) AS change FROM x""")(lambda f: distribution.share_change(f.live, remote(), AS_OF, WINDOW))
entry("coverage", "SELECT count(DISTINCT country) AS country, count(DISTINCT company) AS company_name FROM win")(lambda f: distribution.coverage(f.window, "country", "company_name"))

_STATS = "count(pay) AS sample_size, round(CASE WHEN count(pay) >= {k} THEN avg(pay) END, 6) AS average, round(CASE WHEN count(pay) >= {k} THEN quantile_cont(pay, 0.25) END, 6) AS p25, round(CASE WHEN count(pay) >= {k} THEN quantile_cont(pay, 0.5) END, 6) AS median, round(CASE WHEN count(pay) >= {k} THEN quantile_cont(pay, 0.75) END, 6) AS p75, round(CASE WHEN count(pay) >= {k} THEN quantile_cont(pay, 0.9) END, 6) AS p90, round(CASE WHEN count(pay) >= {k} THEN min(pay) END, 6) AS low, round(CASE WHEN count(pay) >= {k} THEN max(pay) END, 6) AS high"
entry("salary_overview", ", o AS (SELECT CASE WHEN seen AND pay > 0 THEN pay END AS pay, seen AND pay > 0 AS s FROM win) SELECT " + _STATS.format(k=5) + ", round(coalesce(avg(s::INT), 0), 6) AS observed_share FROM o")(lambda f: salary.overview(f.window))
entry("salary_suppressed", ", o AS (SELECT pay FROM (SELECT * FROM win WHERE seen AND pay > 0 ORDER BY id LIMIT 3)) SELECT " + _STATS.format(k=5) + ", 1.0::DOUBLE AS observed_share FROM o")(lambda f: salary.overview(f.window.filter(salary.observed()).orderBy("id").limit(3)))
entry("salary_by_segment", ", o AS (SELECT segment, pay FROM jobs WHERE seen) SELECT segment, count(*) AS n, round(quantile_cont(pay, 0.5), 6) AS median FROM o GROUP BY 1 HAVING count(*) >= 5")(lambda f: salary.median_by_segment(f.all))
for _dim, _sql in zip(salary.DIMENSIONS, ("prio", "segment", "country", "prio", "kind", "company", "city"), strict=True):
    entry(f"salary_by_{_dim}", f"SELECT {_sql} AS value, " + _STATS.format(k=5) + f" FROM win WHERE seen AND pay > 0 GROUP BY 1 HAVING count(pay) >= 5 ORDER BY quantile_cont(pay, 0.5) DESC, 1 LIMIT 20")(lambda f, d=_dim: salary.by(f.window, d))
entry("salary_for_skill", ", o AS (SELECT CASE WHEN seen AND pay > 0 THEN pay END AS pay FROM met WHERE slug = 'Brand#23') SELECT " + _STATS.format(k=5) + " FROM o")(lambda f: salary.for_skill(f.window, f.bridge, "Brand#23"))

entry("country_demand", """, c AS (SELECT country, count(*) AS n, count(*) FILTER (remote) AS r FROM win GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, country LIMIT 10)
SELECT country, n, round(r / n, 6) AS remote_share, round(n / sum(n) OVER (), 6) AS share, round(n / (SELECT sum(n) FROM c), 6) AS share_of_total FROM t""")(lambda f: market.places(f.window, ["country"], remote(), 10))
entry("city_demand", """, c AS (SELECT city, region, country, count(*) AS n, count(*) FILTER (remote) AS r FROM win GROUP BY 1, 2, 3), t AS (SELECT * FROM c ORDER BY n DESC, city, region, country LIMIT 10)
SELECT city, region, country, n, round(r / n, 6) AS remote_share, round(n / sum(n) OVER (), 6) AS share, round(n / (SELECT sum(n) FROM c), 6) AS share_of_total FROM t""")(lambda f: market.places(f.window, ["city", "region", "country"], remote(), 10))
entry("company_top_hiring", """, t AS (SELECT company, count(*) AS n, count(*) FILTER (remote) AS r FROM win GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
m AS (SELECT company, count(*) FILTER (e >= TIMESTAMP '2000-08-02' AND e < TIMESTAMP '2001-08-02') AS a, count(*) FILTER (e >= TIMESTAMP '1999-08-03' AND e < TIMESTAMP '2000-08-02') AS b FROM live GROUP BY 1)
SELECT company AS company_name, n, a AS current, b AS previous, round(CASE WHEN b > 0 THEN 100.0::DOUBLE * (a - b) / b END, 6) AS growth, round(r / n, 6) AS remote_share FROM t JOIN m USING (company)""")(lambda f: market.hiring(f.live, f.window, remote(), AS_OF, WINDOW))
entry("company_growth", "SELECT company AS company_name, count(*) FILTER (e >= TIMESTAMP '2000-08-02') AS current, count(*) FILTER (e < TIMESTAMP '2000-08-02') AS previous FROM live WHERE e >= TIMESTAMP '1999-08-03' AND e < TIMESTAMP '2001-08-02' GROUP BY 1")(lambda f: market.growth_map(f.live, AS_OF, WINDOW))
entry("company_top_skills", ", c AS (SELECT company, slug, count(*) AS n FROM lmet GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, slug) AS rank FROM c) SELECT company AS company_name, slug, n, rank, round(n / max(n) OVER (PARTITION BY company), 6) AS share FROM r WHERE rank <= 5")(lambda f: market.company_skills(f.live, f.bridge, 5))
entry("company_counters", "SELECT company AS company_name, count(*) FILTER (status = 'active') AS active, count(*) AS total FROM jobs GROUP BY 1")(lambda f: market.counters(f.all))
entry("segment_summary", """, b AS (SELECT segment, count(*) AS n, count(*) FILTER (remote) AS r, count(*) FILTER (seen AND pay > 0) AS k, quantile_cont(CASE WHEN seen AND pay > 0 THEN pay END, 0.5) AS m FROM win GROUP BY 1),
g AS (SELECT segment, count(*) FILTER (e >= TIMESTAMP '2000-08-02' AND e <= TIMESTAMP '2001-08-02') AS a, count(*) FILTER (e >= TIMESTAMP '1999-08-03' AND e <= TIMESTAMP '2000-08-02') AS p FROM live GROUP BY 1),
s AS (SELECT segment, slug, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, slug) AS i FROM met GROUP BY 1, 2),
l AS (SELECT segment, string_agg(slug, ',' ORDER BY i) AS top_skills FROM s WHERE i <= 5 GROUP BY 1)
SELECT segment, n, round(n / sum(n) OVER (), 6) AS share, round(r / n, 6) AS remote_share, round(CASE WHEN k >= 5 THEN m END, 6) AS median_salary, round(CASE WHEN p > 0 THEN 100.0::DOUBLE * (a - p) / p END, 6) AS growth, top_skills FROM b JOIN g USING (segment) JOIN l USING (segment)""")(lambda f: market.segments(f.live, f.window, f.bridge, remote(), AS_OF, WINDOW))
entry("market_overview", """, a AS (SELECT count(*) FILTER (status = 'active') AS active_jobs, count(*) AS total_jobs, count(*) FILTER (e >= TIMESTAMP '2001-08-02') AS new_today, count(*) FILTER (e >= TIMESTAMP '2001-07-26') AS new_week, round(greatest(0, epoch(TIMESTAMP '2001-08-02' - max(e)) / 3600), 6) AS freshness_hours FROM jobs),
b AS (SELECT count(DISTINCT company) AS companies, count(DISTINCT country) AS countries, round(count(*) FILTER (remote) / count(*), 6) AS remote_share, count(*) FILTER (seen AND pay > 0) AS samples, round(quantile_cont(CASE WHEN seen AND pay > 0 THEN pay END, 0.5), 6) AS median_salary FROM win) SELECT * FROM a, b""")(lambda f: market.overview(f.all, f.window, remote(), AS_OF))
entry("market_fit", """, t AS (SELECT slug, n FROM single ORDER BY n DESC, slug LIMIT 10), c AS (SELECT sum(n) FILTER (slug IN ('Brand#11', 'Brand#23', 'Brand#35', 'Brand#44')) / sum(n) AS v FROM t), m AS (SELECT least(1, count(*) / 50) AS v FROM met WHERE slug = 'Brand#11')
SELECT round(coalesce(c.v, 0), 6) AS coverage, round(0.6 * coalesce(c.v, 0) + 0.25 * m.v + 0.15 * 4 / 12, 6) AS score FROM c, m""")(lambda f: market.fit(f.window, f.bridge, OWNED, skills.any_of(f.window, f.bridge, OWNED[:1]).count(), 10))
entry("missing_skills", ", t AS (SELECT slug, n, row_number() OVER (ORDER BY n DESC, slug) AS rank FROM single) SELECT slug, n, rank, round(n / total, 6) AS share FROM t, total WHERE rank <= 20 AND slug NOT IN ('Brand#11', 'Brand#23', 'Brand#35', 'Brand#44') ORDER BY rank LIMIT 10")(lambda f: market.missing(f.window, f.bridge, OWNED, 20))

_SEARCH = """, terms AS (SELECT id, e, company, segment || ' ' || prio AS title, lower(company || ' ' || segment || ' ' || country || ' ' || prio) AS body FROM live),
hit AS (SELECT *, 3 * (contains(lower(title), 'build')::INT + contains(lower(title), 'high')::INT) + 1.5::DOUBLE * (contains(lower(company), 'build')::INT + contains(lower(company), 'high')::INT) + (contains(body, 'build')::INT + contains(body, 'high')::INT) AS score FROM terms WHERE contains(body, 'build') AND contains(body, 'high'))
"""


def _postings(f: Frame) -> DataFrame:
    """The searchable columns of live postings."""
    title = F.concat_ws(" ", "segment", "remote_type")
    return f.live.select("id", "e", "company_name", title.alias("title"), F.lower(F.concat_ws(" ", "company_name", "segment", "country", "remote_type")).alias("search_text"), F.lower(F.concat_ws(" ", "company_name", "segment", "country", "remote_type")).alias("snippet"), F.lit(0.0).alias("quality_score"), F.array().cast("array<string>").alias("skills"))


entry("search_multi_term", _SEARCH + "SELECT count(*) AS n FROM hit")(lambda f: search.matching(_postings(f), "High BUILD").agg(F.count("*").alias("n")))
entry("search_relevance", _SEARCH + "SELECT id, round(score, 6) AS score FROM hit ORDER BY hit.score DESC, e DESC, id LIMIT 20")(lambda f: search.ranked(_postings(f), "High BUILD", limit=20).select("id", "score"))
entry("suggest_prefix", "SELECT segment || ' ' || prio AS title, count(*) AS n FROM live WHERE starts_with(lower(segment || ' ' || prio), 'au') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda f: search.suggest(_postings(f), "Au"))
entry("listing_page", "SELECT id, pay FROM win WHERE pay >= 100000 AND region = 'ASIA' ORDER BY pay DESC, id LIMIT 25 OFFSET 50")(lambda f: search.page(f.window.filter((F.col("salary_mid") >= 100000) & (F.col("region") == "ASIA")), "salary_mid", True, 25, 50).select("id", F.col("salary_mid").alias("pay")))

entry("alert_evaluation", """, v AS (SELECT 'skill_job_count' AS metric, slug AS subject, count(*)::DOUBLE AS value FROM met GROUP BY 2 UNION ALL SELECT 'company_job_count', lower(company), count(*)::DOUBLE FROM win GROUP BY 2
 UNION ALL SELECT 'total_active_jobs', '', count(*)::DOUBLE FROM live UNION ALL SELECT 'remote_share_pct', '', 100.0 * count(*) FILTER (remote) / count(*) FROM win),
r AS (SELECT * FROM (VALUES (1, 'skill_job_count', 'Brand#23', 'gte', 5.0), (2, 'skill_job_count', 'none', 'gt', 0.0), (3, 'total_active_jobs', '', 'lt', 10.0), (4, 'remote_share_pct', '', 'lte', 50.0)) t(rule_id, metric, subject, operator, threshold))
SELECT rule_id::BIGINT AS rule_id, round(coalesce(value, 0), 6) AS value, CASE operator WHEN 'gt' THEN coalesce(value, 0) > threshold WHEN 'gte' THEN coalesce(value, 0) >= threshold WHEN 'lt' THEN coalesce(value, 0) < threshold WHEN 'lte' THEN coalesce(value, 0) <= threshold END AS triggered FROM r LEFT JOIN v ON r.metric = v.metric AND r.subject = v.subject""")(lambda f: alerts.evaluate(_rules(f.spark), alerts.readings(f.all, f.window, f.bridge, remote()), AS_OF).select("rule_id", "value", "triggered"))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.sql("""SELECT rule_id, metric, subject, operator, threshold, true AS enabled, 60 AS cooldown_minutes, CAST(NULL AS TIMESTAMP) AS last_triggered_at, array('in_app', 'email') AS channels FROM VALUES
        (1L, 'skill_job_count', 'Brand#23', 'gte', 5.0D), (2L, 'skill_job_count', 'none', 'gt', 0.0D), (3L, 'total_active_jobs', '', 'lt', 10.0D), (4L, 'remote_share_pct', '', 'lte', 50.0D) AS t(rule_id, metric, subject, operator, threshold)""")


_QUALITY = """, q AS (SELECT segment AS source, prio, pay, seen, e, country FROM jobs)
"""
entry("quality_by_source", _QUALITY + """, d AS (SELECT source, count(*) AS n, avg((CASE WHEN country IS NOT NULL THEN 1.0 ELSE 0 END + CASE WHEN seen THEN 0.5 ELSE 0 END) / 1.5) AS completeness, avg(greatest(0, 1 - floor(epoch(TIMESTAMP '2001-08-02' - e) / 86400) / 60)) AS freshness FROM q GROUP BY 1)
SELECT source, n, round(completeness, 6) AS completeness, round(freshness, 6) AS freshness FROM d""")(lambda f: f.all.groupBy(F.col("segment").alias("source")).agg(F.count("*").alias("n"), quality.completeness({"country": 1.0, "seen": 0.5}, {"country": F.col("country").isNotNull(), "seen": F.col("salary_provenance") == "observed"}).alias("completeness"), quality.freshness(F.col("published_at"), AS_OF).alias("freshness")))
entry("field_quality", "SELECT 'country' AS field, count(country) AS present, count(*) - count(country) AS missing FROM jobs UNION ALL SELECT 'salary_mid', count(CASE WHEN seen THEN pay END), count(*) - count(CASE WHEN seen THEN pay END) FROM jobs")(lambda f: quality.fields(f.all.withColumn("salary_mid", F.when(F.col("salary_provenance") == "observed", F.col("salary_mid"))), ["country", "salary_mid"]))

entry("upsert_merge", """, old AS (SELECT id, e, 'active' AS status, id % 7 AS h FROM jobs WHERE id % 3 <> 0), new AS (SELECT id, e + INTERVAL 1 DAY AS e, 'active' AS status, id % 5 AS h FROM jobs WHERE id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.status WHEN o.id IS NULL THEN 'active' WHEN o.h <> n.h THEN 'updated' ELSE o.status END AS status, coalesce(n.h, o.h)::BIGINT AS content_hash, coalesce(o.e, n.e) AS first_seen_at FROM old o FULL JOIN new n ON o.id = n.id""")(lambda f: _merged(f))


def _merged(f: Frame) -> DataFrame:
    old = f.all.filter(F.col("id") % 3 != 0).select("id", F.col("e").alias("first_seen_at"), F.lit("active").alias("status"), (F.col("id") % 7).alias("content_hash"))
    new = f.all.filter(F.col("id") % 2 == 0).select("id", F.expr("e + INTERVAL 1 DAY").alias("first_seen_at"), F.lit("active").alias("status"), (F.col("id") % 5).alias("content_hash"))
    return maintenance.upsert(old, new, ["id"]).select("id", "status", "content_hash", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"))


entry("expire_stale", "SELECT CASE WHEN status = 'active' AND e < TIMESTAMP '2001-06-18' THEN 'expired' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY 1")(lambda f: maintenance.expire(f.all.withColumn("last_seen_at", F.col("e")), datetime(2001, 6, 18)).groupBy("status").agg(F.count("*").alias("n")))
entry("latest_per_key", ", r AS (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY e DESC, id DESC) AS i FROM jobs) SELECT company AS company_name, id FROM r WHERE i = 1")(lambda f: maintenance.latest(f.all.select("company_name", "id", "e"), ["company_name"], ["e", "id"]).select("company_name", "id"))
entry("new_keys_anti", "SELECT DISTINCT company AS company_name FROM jobs WHERE e >= TIMESTAMP '2001-01-01' AND company NOT IN (SELECT company FROM jobs WHERE e < TIMESTAMP '2001-01-01')")(lambda f: maintenance.new_keys(f.all.filter("e >= '2001-01-01'"), f.all.filter("e < '2001-01-01'"), ["company_name"]))
entry("salary_facts", "SELECT id AS job_id, pay AS annual_midpoint, segment FROM jobs WHERE seen")(lambda f: maintenance.salary_facts(f.all.withColumn("salary_currency", F.lit("USD"))).select("job_id", "annual_midpoint", "segment"))
