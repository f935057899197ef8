"""Exact quantiles of groups by rank selection: no task ever holds a group.

Values are counted first, so repeats cost nothing after that. A group of more than ``most`` distinct values is cut into ranges
at approximate quantiles of its distinct values; exact counts of the ranges say which of them hold the ranks asked for, and
only those are kept and cut again until each is small. Where the cuts lie changes the work only, never a result.

Between two ranks the value is interpolated linearly. Nulls in the values don't count; a group with none else has no row. Null keys
are a group. NaN is the greatest value, as in every sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import tables

#: Distinct values one task sorts, ranges a cut makes, pieces a group is dealt in for a join.
MOST, RANGES, DEALT = 65_536, 64, 32


def _place(p: float) -> Column:
    return F.lit(p) * (F.col("n") - 1)


def _cut(big: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ranges of ``big`` (g, part, v, c) that hold a rank of ``asked`` (g, part, rank, r), as both tables over the new parts."""
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = big.groupBy("g", "part").agg(F.array_distinct(F.percentile_approx("v", steps, F.lit(10 * RANGES))).alias("cuts"))
    # a hot group meets its one row of cuts in many tasks; groups cut here are over `most` rows each, so the copies are few
    dealt = cuts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    ranged = big.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEALT)).cast("int")).join(dealt, ["g", "part", "deal"])
    place = F.size(F.filter("cuts", lambda x: x < F.col("v")))
    ranged = tables.stage(ranged.select("g", "part", (F.col("part") * RANGES + place).alias("sub"), "deal", "v", "c"), "ranged")
    weights = ranged.groupBy("g", "part", "sub").agg(F.sum("c").alias("w"))
    # at most RANGES rows in a window
    before = F.coalesce(F.sum("w").over(Window.partitionBy("g", "part").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = asked.join(weights.withColumn("before", before), ["g", "part"]).filter("r >= before AND r < before + w")
    asked = tables.stage(held.select("g", F.col("sub").alias("part"), "rank", (F.col("r") - F.col("before")).alias("r")), "ranks")
    kept = asked.select("g", F.col("part").alias("sub")).distinct().withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return ranged.join(kept, ["g", "sub", "deal"], "left_semi").select("g", F.col("sub").alias("part"), "v", "c"), asked


def exact(df: DataFrame, keys: list[str], value: Column, probabilities: list[float], most: int = MOST) -> DataFrame:
    """(keys, n, q): values counted and the quantiles of each group as an array in the order of ``probabilities``."""
    if not probabilities or any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are from 0 to 1, one at least")
    if most < 2:
        raise ValueError("a task sorts two values at least")
    group = F.struct(F.lit(0).alias("_"), *keys)  # equal also where a key is null
    values = df.select(group.alias("g"), value.cast("double").alias("v")).filter("v IS NOT NULL")
    values = tables.stage(values.groupBy("g", "v").agg(F.count("*").alias("c")).withColumn("part", F.lit(1).cast("long")), "values")
    sizes = tables.stage(values.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("d")), "sizes")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_place(p)), F.ceil(_place(p))) for p in probabilities])))
    asked = sizes.select("g", F.lit(1).cast("long").alias("part"), F.explode(ranks).alias("rank")).withColumn("r", F.col("rank"))
    small, parts = [], sizes.select("g", F.lit(1).cast("long").alias("part"), "d")  # part 1 has the parts 64 to 127, and so on: no number twice
    while parts.filter(F.col("d") > most).limit(1).count():
        large = parts.filter(F.col("d") > most).select("g", "part").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        marked = values.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEALT)).cast("int"))
        small.append((values.join(parts.filter(F.col("d") <= most).select("g", "part"), ["g", "part"], "left_semi"), asked.join(large, ["g", "part"], "left_anti")))
        values, asked = _cut(marked.join(large, ["g", "part", "deal"], "left_semi").drop("deal"), asked.join(large.select("g", "part").distinct(), ["g", "part"], "left_semi"))
        values = tables.stage(values, "values")
        parts = tables.stage(values.groupBy("g", "part").agg(F.count("*").alias("d")), "parts")
    values, asked = reduce(lambda a, b: (a[0].unionByName(b[0]), a[1].unionByName(b[1])), small, (values, asked))
    # at most `most` rows in a window
    upto = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = asked.groupBy("g", "part").agg(F.collect_list(F.struct("r", "rank")).alias("wanted"))  # two for each probability at most
    met = values.withColumn("upto", upto).join(wanted, ["g", "part"])
    met = met.select("g", "v", F.explode(F.filter("wanted", lambda x: (x["r"] < F.col("upto")) & (x["r"] >= F.col("upto") - F.col("c")))["rank"]).alias("rank"))
    found = met.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")).join(sizes, "g")

    def between(p: float) -> Column:
        low, high = (F.element_at("at", f(_place(p))) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(_place(p)) - _place(p)) * low + (_place(p) - F.floor(_place(p))) * high)

    return found.select(*[F.col("g")[k].alias(k) for k in keys], "n", F.array(*[between(p) for p in probabilities]).alias("q"))
