"""Exact quantiles by rank selection against the percentiles of whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.77, 1.0]


def rows():
    draw = np.random.default_rng(3)
    out = [("hot", float(v)) for v in draw.lognormal(10, 1, 5000)]  # all distinct: cut twice below
    out += [("ties", float(v)) for v in draw.integers(0, 7, 3000)]
    out += [(None, float(v)) for v in draw.normal(0, 5, 401)] + [("one", 4.5), ("two", -1.0), ("two", 2.0), ("none", None), ("hot", None)]
    return out


@pytest.mark.parametrize("most", [40, 79, quantiles.MOST])
def test_as_over_whole_groups(spark, most):
    got = quantiles.exact(spark.createDataFrame(rows(), "k string, v double"), ["k"], F.col("v"), PROBABILITIES, most)
    got = {r.k: (r.n, r.q) for r in got.collect()}
    held = {}
    for k, v in rows():
        if v is not None:
            held.setdefault(k, []).append(v)
    assert set(got) == set(held) and "none" not in got and None in got
    for k, values in held.items():
        assert got[k][0] == len(values)
        assert got[k][1] == pytest.approx(np.quantile(values, PROBABILITIES).tolist(), rel=1e-12, abs=1e-12)


def test_without_keys_and_empty(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    assert [(r.n, r.q) for r in quantiles.exact(df, [], F.col("v"), [0.5], 10).collect()] == [(1000, [49.5])]
    assert quantiles.exact(df.filter("v < 0"), [], F.col("v"), [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact(df, [], F.col("v"), [1.5])


def test_no_window_over_more_than_the_bound(spark):
    """The last cut's parts are small: the rows that reach a sort are a fraction of the group."""
    big = spark.range(20_000).select(F.lit("g").alias("k"), F.lit(0).cast("long").alias("part"), F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("c")).withColumn("g", F.struct("k")).drop("k")
    asked = big.select("g", "part").distinct().select("*", F.lit(10_000).cast("long").alias("rank"), F.lit(10_000).cast("long").alias("r"))
    kept, ranks = quantiles._cut(big, asked)
    assert 0 < kept.count() <= 20_000 * 3 // quantiles.RANGES
    assert [r.rank for r in ranks.collect()] == [10_000]
