"""Operator 6, URL filter by logistic regression on hashed character n-grams. DataFrame functions only.

Rules (host, path, verdict) come first: a rule fits its host and all subdomains if the url's path starts with
the rule's path; the longest (host, then path) wins. Urls that no rule fits are judged by a logistic
regression on hashed character 3-grams of ``^host$path^``, trained on a small labelled table of urls (a
parameter; its size is the table's, not the corpus's). The hash is a polynomial of code points, so
the model is plain arithmetic in any SQL.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
method. Repeated rows are judged each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SLOTS = 4096
#: (host, path, verdict) of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def labelled_urls() -> list[tuple[str, str, int]]:
    """The small training table (host, path, 1 to block): hosts and paths of either kind, combined by rule."""
    bad_hosts = ("casino-bonus", "cheap-pills", "hotgirls-cam", "win-prizes", "free-crack", "xxx-videos", "bet365win", "loan-fast-cash")
    good_hosts = ("news", "docs", "blog", "wiki", "university", "library", "city-council", "research")
    bad_paths = ("/click?aff=99", "/promo/win-now", "/free-download.exe", "/xxx/gallery", "/buy-cheap-pills", "/ads/track")
    good_paths = ("/en/2041", "/de/311.html", "/fr/articles/", "/es/8812", "/about", "/docs/guide")
    zones = ("net", "com", "info")
    bad = [(f"{h}.{zones[(i + j) % 3]}", p, 1) for i, h in enumerate(bad_hosts) for j, p in enumerate(bad_paths)]
    good = [(f"{'www.' * (j % 2)}{h}.example.{zones[(i + j) % 3]}", p, 0) for i, h in enumerate(good_hosts) for j, p in enumerate(good_paths)]
    return bad + good


def slots(text: str) -> list[int]:
    return [(ord(a) * 961 + ord(b) * 31 + ord(c)) % SLOTS for a, b, c in zip(text, text[1:], text[2:], strict=False)]


@lru_cache
def train(rows: tuple[tuple[str, str, int], ...], epochs: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> tuple[tuple[float, ...], float]:
    """Weights per slot (rounded to 6 digits) and bias of the mean-of-3-grams logistic regression."""
    data = [(slots(f"^{h}${p}^"), y) for h, p, y in rows]
    w, bias = [0.0] * SLOTS, 0.0
    for epoch in range(epochs):
        step = rate * 20 / (1 + epoch / 10)
        for at, y in data:
            n = max(len(at), 1)
            z = bias + sum(w[k] for k in at) / n
            error = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += rate / 10 * error
            for k in at:
                w[k] += step * (error / n - ridge * w[k] / n)
    return tuple(round(x, 6) for x in w), round(bias, 6)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.substr(url, F.char_length(rest) + 4)
    host = F.coalesce(F.regexp_extract(after, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def log_odds(host: Column, path: Column, model: tuple[tuple[float, ...], float]) -> Column:
    """Log-odds of block."""
    weights, bias = model
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    text = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("^"))
    n = F.char_length(text) - 2
    code = lambda i, k: F.ascii(F.substr(text, i + k, F.lit(1)))
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(table, ((code(i, 0) * 961 + code(i, 1) * 31 + code(i, 2)) % SLOTS + 1).cast("int")))
    return F.lit(bias) + F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n


def judge(pages: DataFrame, rules: tuple = RULES, labelled: tuple | None = None) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, verdict and score (probability of block; null where a rule decides)."""
    model = train(tuple(labelled if labelled is not None else labelled_urls()))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score", "_rule")]
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):
        fits = ((F.col("host") == r_host) | F.endswith("host", F.lit("." + r_host))) & F.startswith("path", F.lit(r_path))
        rule = F.when(fits, F.lit(r_host + r_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r_verdict)).otherwise(verdict)
    ruled = parsed.withColumn("rule", rule).withColumn("_verdict", verdict)
    z = F.when(F.col("rule").isNull(), log_odds(F.col("host"), F.col("path"), model))
    scored = ruled.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(*kept, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_sql() -> str:
    weights, bias = train(tuple(labelled_urls()))
    case = lambda k: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in sorted(RULES, key=lambda r: (len(r[0]), len(r[1])), reverse=True)
    ) + " END"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled, '^' || host || '$' || path || '^' AS t FROM b),
w AS (SELECT {list(weights)}::DOUBLE[] AS w),
d AS (SELECT c.*, {bias} + list_sum(list_transform(range(1, length(t) - 1), lambda i: w.w[(ord(substr(t, i, 1)) * 961 + ord(substr(t, i + 1, 1)) * 31 + ord(substr(t, i + 2, 1))) % {SLOTS} + 1])) / (length(t) - 2) AS z FROM c, w)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN 1 / (1 + exp(-z)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM d
"""
