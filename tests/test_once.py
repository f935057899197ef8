"""Costly steps over texts run once a row, in bounded memory."""

import tracemalloc
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import dedup, postings, records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def peak(make):
    tracemalloc.start()
    try:
        make()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def postings_of(spark):
    row = ("s", "dataset", "1", "https://example.com/1", "Data Engineer", "We look for <b>one</b> who writes Python &amp; SQL, five years of it.", "Firm", "Berlin", "no", None, "Full-time", None, datetime(2024, 5, 1), datetime(2024, 6, 1))
    raw = spark.createDataFrame([row], "source string, source_kind string, source_job_id string, url string, title string, description string, company string, location string, remote_status string, salary string, employment_type string, industry string, published_at timestamp, collected_at timestamp")
    return postings.from_raw(raw, datetime(2024, 6, 1))[0]


def test_records_are_cleaned_once(spark):
    found = postings_of(spark)
    text = plan(found)
    assert text.count("ArrowEvalPython") == 2  # cleaning, and the text that the content hash takes
    assert text.count("noscript") < 60
    assert found.first()["description"] == "We look for one who writes Python & SQL, five years of it."


def test_markup_is_stripped_once(spark):
    df = spark.createDataFrame([("a <b>x</b> &amp;lt;i&amp;gt;y",), ("Weâ€™re <p>here</p>",), ("plain: a > b",), (None,)], "t string")
    text = plan(df.select(tx.repair_mojibake(tx.strip_html(F.col("t"))).alias("c")))
    assert text.count("noscript") == 2  # a pass, and the one for escaped markup
    assert [r[0] for r in df.select(tx.repair_mojibake(tx.strip_html(F.col("t")))).collect()] == ["a x &lt;i&gt;y", "We're \nhere\n", "plain: a > b", None]


def test_run_schemes_with_blanks_inside(spark):
    df = spark.createDataFrame([("a j a\tva\nscript : b",), ("VBScript:x",), ("javascript is a word",), ("java: script",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(records.active(F.col("t"))).collect()] == [True, True, False, False, False, None]


def test_texts_are_composed_in_slices():
    texts = pa.array(["ﬁ" + "e" * 2000, None, ""] * 3000)
    assert tx._composed(texts.slice(0, 3)).to_pylist() == ["fi" + "e" * 2000, None, ""]
    assert tx._composed(texts.slice(0, 0)).type == pa.string()
    assert peak(lambda: tx._composed(texts)) < 5


def test_signatures_in_bounded_memory():
    assert peak(lambda: dedup.minima(np.arange(50_000))) < 5  # 51 MB for each array of a hash and permutation
    texts = pa.array(["one two three four five six seven " * 9, None, "", "a"] * 500)
    found = dedup._signatures(texts)
    assert found.slice(0, 4).to_pylist() == [dedup.minima(dedup.shingle_hashes(v)) for v in texts.slice(0, 4).to_pylist()]
    assert dedup._signatures(texts.slice(0, 0)).to_pylist() == []
    a, b = dedup._coefficients()
    hashes = np.random.default_rng(1).integers(0, dedup.PRIME, 700, endpoint=True, dtype=np.uint64)
    assert dedup.minima(hashes) == [min((int(h) * int(x) + int(y)) % dedup.PRIME for h in hashes) for x, y in zip(a, b, strict=True)]


def test_texts_are_signed_once(spark):
    shared = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(k, f"{shared} {k % 3}") for k in range(9)], "id long, text string").groupBy("text").agg(F.min("id").alias("id"))
    signed = docs.select("id", F.col("id").alias("ord"), dedup.signature("text").alias("sig"))
    assert plan(signed.filter(F.size("sig") > 0)).count("ArrowEvalPython") == 1
    near = dedup.near_pairs(signed)
    assert "EvalPython" not in plan(near)
    assert {(r["later"], r["earlier"]) for r in near.collect()} == {(1, 0), (2, 0), (2, 1)}
