"""Trees kept as (child, parent) rows: ancestors, descendants, children, paths and sums over subtrees, level by level.

A level of the walk is one join of the last level with the edges, so there are as many joins as the tree is deep, whatever its
size; each level is staged. A child has one parent; a null parent is a root. A cycle is found when a node meets itself, and refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import tables


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance): every node with itself at 0 and each of its ancestors; ``edges`` is (child, parent), a row for each node."""
    known = tables.stage(edges.select("child", "parent"), "tree")
    double = known.groupBy("child").agg(F.count("*").alias("n")).filter("n > 1 OR child IS NULL").limit(1).collect()
    if double:
        raise ValueError(f"{double[0]['child']} stands in the tree {double[0]['n']} times")
    lost = known.filter("parent IS NOT NULL").join(known.select(F.col("child").alias("parent")), "parent", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"the parent {lost[0]['parent']} isn't in the tree")
    levels = [known.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("distance"))]
    up = known.filter("parent IS NOT NULL").select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    while True:
        last = levels[-1].join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        last = tables.stage(last, "tree")
        if last.filter("node = ancestor").limit(1).count():
            raise ValueError("the tree has a cycle")
        if not last.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        levels.append(last)


def descendants(pairs: DataFrame, root: str) -> DataFrame:
    """(node, distance) below a node, nearest first, of a ``closure``."""
    return pairs.filter((F.col("ancestor") == root) & (F.col("distance") > 0)).select("node", "distance").orderBy("distance", "node")


def children(edges: DataFrame, node: str | None) -> DataFrame:
    """The direct children of a node, or the roots."""
    return edges.filter(F.col("parent").eqNullSafe(F.lit(node))).select("child").orderBy("child")


def laid_out(pairs: DataFrame, sep: str = "/") -> DataFrame:
    """(node, depth, path, n_below): each node with its path from the root and the number of nodes below it; by path it is the tree as it is printed."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))), lambda s: s["ancestor"])  # as many as the tree is deep
    paths = pairs.groupBy("node").agg(F.max("distance").alias("depth"), F.array_join(steps, sep).alias("path"))
    below = pairs.filter("distance > 0").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_below"))
    return paths.join(below, "node", "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)).cast("long"))


def subtree_sums(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(node, total) of ``values`` (node, value) over each node and all below it; summed by node first, so rows don't multiply."""
    own = values.groupBy("node").agg(F.sum("value").alias("value"))
    return own.join(pairs, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("value").alias("total"))
