"""Golden pairs of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, stats, text, urls


def one(spark, expr, **values):
    kinds = {str: "string", int: "bigint", float: "double"}
    row = spark.range(1).select(*[F.lit(v).cast(kinds.get(type(v), "string")).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given,expected",
    [
        ("<div><p>Hello <b>World</b></p><script>alert(1)</script></div>", "Hello World"),
        ("<p>Hello&nbsp;&amp;   welcome</p>", "Hello & welcome"),
        ("&lt;h2&gt;Title&lt;/h2&gt;&lt;p&gt;Python &amp;amp; Go&lt;/p&gt;", "Title Python & Go"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_text(spark, given, expected):
    assert one(spark, text.clean_text(F.col("c")), c=given) == expected
    assert one(spark, text.collapse(F.coalesce(text.strip_html_exact(F.col("c")), F.lit(""))), c=given) == expected


@pytest.mark.parametrize(
    "function,given,expected",
    [
        (text.canonical_key, "Zürich, Schweiz!", "zurich schweiz"),
        (text.slugify, "Acme Analytics GmbH", "acme-analytics-gmbh"),
        (text.tokenize, "Senior C++ Developer", ["senior", "c++", "developer"]),
        (text.tokenize, "Node.js / TypeScript", ["node.js", "typescript"]),
        (lambda c: text.truncate(c, 6), "abcdefghij", "abc..."),
        (lambda c: text.contains_word(c, "go"), "we use go daily", True),
        (lambda c: text.contains_word(c, "go"), "golang is great", False),
        (text.repair_mojibake, "Weâ€™re hiring", "We're hiring"),
        (text.is_null_token, "  unknown  ", True),
        (text.is_null_token, None, True),
        (text.is_null_token, "Berlin", False),
        (text.normalize_unicode, "ﬁne​", "fine"),
        (urls.normalize_url, "HTTPS://WWW.Example.com:443/jobs/1/?utm_source=x&b=2&a=1#frag", "https://example.com/jobs/1?a=1&b=2"),
        (urls.normalize_url, None, ""),
        (urls.normalize_url, "example.com", "https://example.com/"),
    ],
)
def test_text(spark, function, given, expected):
    assert one(spark, function(F.col("c")), c=given) == expected


def test_shingles(spark):
    tokens = F.split("c", " ")
    assert one(spark, text.shingles(tokens, 2), c="a b c d") == ["a b", "b c", "c d"]
    assert one(spark, text.shingles(tokens, 5), c="a b") == ["a", "b"]


@pytest.mark.parametrize("given", ["2024-03-01T10:00:00Z", "2024-03-01 10:00:00", "Fri, 01 Mar 2024 10:00:00 GMT", "1709287200"])
def test_dates(spark, given):
    assert one(spark, F.date_format(dates.parse_datetime(F.col("c")), "yyyy-MM-dd HH"), c=given) == "2024-03-01 10"


def test_no_date(spark):
    assert one(spark, dates.parse_datetime(F.col("c")), c="not a date") is None
    assert one(spark, dates.humanize_duration(F.col("c")), c=75.0) == "1m 15s"


@pytest.mark.parametrize("change,cv,points,expected", [(25.0, 0.2, 6, "rising"), (-25.0, 0.2, 6, "declining"), (2.0, 0.0, 6, "stable"), (None, 0.0, 2, "insufficient_data"), (5.0, 0.9, 6, "volatile")])
def test_trend(spark, change, cv, points, expected):
    row = spark.range(1).select(F.lit(change).cast("double").alias("a"), F.lit(cv).alias("b"), F.lit(points).alias("n"))
    assert row.select(stats.trend(F.col("a"), F.col("b"), F.col("n"))).first()[0] == expected


def test_statistics(spark):
    df = spark.range(1, 11)
    assert df.agg(F.percentile("id", 0.5)).first()[0] == 5.5
    assert df.agg(F.percentile("id", 0.25)).first()[0] == 3.25
    assert one(spark, stats.percent_change(F.col("a"), F.col("b")), a=10.0, b=5.0) == 100.0
    assert one(spark, stats.percent_change(F.col("a"), F.col("b")), a=5.0, b=0.0) is None
    dense = stats.dense_days(spark.sql("SELECT DATE'2024-01-01' AS day, 5L AS n UNION ALL SELECT DATE'2024-01-03', 3L"), "2024-01-01", "2024-01-04")
    assert [r.n for r in dense.orderBy("day").collect()] == [5, 0, 3, 0]


def test_canonical_key_of_any_text(spark):
    """The Column against the same key on the driver: ligatures, full-width, squared, circled, raised and mathematical letters."""
    import random

    from tidemark.functions.keys import canonical_key_of

    rng = random.Random(12)
    given = ["\ufb01ne \uff37ork", "\u2460\u2469 \u00bd \u2122 \u2116 x\u00b2", "\U0001d400\U0001d7d9", "\u33a1 \u3392", None, "", "Caf\u00e9 \u0130stanbul e\u0301"]
    given += ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x2000, 0x33FF), rng.randint(0xF900, 0xFFFD)])) for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(g,) for g in given], "c string")
    got = [r[0] for r in df.select(text.canonical_key(F.col("c"))).collect()]
    assert got == [canonical_key_of(g) for g in given] and got[0] == "fine work"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("a < b and c > d", "a < b and c > d"), ("<p>one<p>two", "one two"), ("x<!-- <b>no</b> -->y", "xy"), ("open <b", "open <b"), ("&eacute;&#233;&copy;", "éé©"),
        ("<style>p{}</style>kept<br/>line", "kept line"), ("<svg><p>no</p></svg>yes", "yes"), ("1 <2> 3", "1 <2> 3"), ("&lt;b&gt;bold&lt;/b&gt;", "bold"),
    ],
)
def test_markup_that_is_not_well_formed(spark, given, expected):
    assert one(spark, text.collapse(text.strip_html_exact(F.col("c"))), c=given) == expected
