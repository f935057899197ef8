"""Collision groups and connected components, both without collecting any group or link.

``collision_cells`` turns rows (key, id) into cells of bounded size in which every two ids that share a key
meet at least once. Keys of one id are dropped, keys with the same set of ids are served once, and a
key with more than ``block`` ids is dealt over pairs of blocks, so no task holds an unbounded group.
``components`` is the alternation of large-star and small-star steps with a staged table per round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import groups, map_batches, stage, unstage


def collision_cells(rows: DataFrame, block: int = 2048, collapse: bool = True) -> DataFrame:
    """(key, i, j, id, ...) from rows (key long, id long, ...), distinct in key and id.

    A cell (key, i, j) has at most 2 * block ids on average. Keys of equal content are served once unless ``collapse`` is off.
    """
    if collapse:
        # a key's content as count and two xors of hashes
        content = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"))
        kept = content.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    else:
        # counts of the other columns keep them, so that the shuffle that ``rows`` may need is one and the same in both branches
        n = F.greatest(F.count("*"), *[F.count(c) for c in rows.columns if c != "key"])
        kept = rows.groupBy("key").agg(n.alias("n")).filter("n > 1")
    # the side with one row per key is hashed, so that the rows needn't be sorted; adaptive execution may still split a hot key's rows
    met = rows.join(kept.select("key", F.ceil(F.col("n") / block).alias("g")).hint("shuffle_hash"), "key").withColumn("b", F.pmod(F.xxhash64("id", F.lit(3)), F.col("g")))
    # one block: one cell; more: a cell for each pair of different blocks
    partners = F.when(F.col("g") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda j: j != F.col("b")))
    dealt = met.withColumn("p", F.explode(partners))
    return dealt.select("key", F.least("b", "p").alias("i"), F.greatest("b", "p").alias("j"), *[c for c in rows.columns if c != "key"])


def cell_links(cells: DataFrame, links: Callable[[list[dict]], list[tuple]], columns: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, ``more``; all long): what ``links`` finds in each cell; ``columns`` are handed to it besides the cell's keys."""
    names = ["a", "b", *more]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(len(names))], names=names)

    def scan(batches):
        found: list[tuple] = []
        for _, rows in groups(batches, ["key", "i", "j"]):
            found += links(rows)
            if len(found) > 50_000:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    dealt = cells.select("key", "i", "j", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_batches(dealt, scan, ", ".join(f"{n} long" for n in names))


def reach(first: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (member, root) that span the components of a cell of ``len(first)`` members.

    ``near(m, rest)`` tells which of the members ``rest`` link to m. Every member is compared with those not
    yet reached only, so a dense cell costs about its size and a sparse one its pairs. ``known`` are the members that
    link to member 0, where it has been compared with all before; links to them aren't given again.
    """
    out, rest, frontier, root = [], np.arange(len(first)), [], 0
    if known is not None:
        left = np.ones(len(first), dtype=bool)
        left[0], left[known] = False, False
        rest, frontier = np.flatnonzero(left), known.tolist()
    while len(rest) and (frontier or len(rest) > 1):
        if not frontier:
            root, rest = int(rest[0]), rest[1:]
            frontier = [root]
        while frontier and len(rest):
            hit = near(frontier.pop(), rest)
            found = rest[hit]
            if len(found):
                rest = rest[~hit]
                frontier += found.tolist()
                out += [(int(m), root) for m in found]
        frontier = []
    return out


def join_hot(rows: DataFrame, side: DataFrame, key: str, by: list[str], share: int = 1000, tasks: int = 64) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key; column n counts the key's rows; a staged table) on ``key``.

    A key with more than 1 / ``share`` of all rows is dealt over ``tasks`` tasks by a hash of the columns ``by``; there
    are fewer than ``share`` such keys, so their broadcast is bounded.
    """
    total = side.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(side.filter(F.col("n") > total / share).select(key, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, key, "left").withColumn("_lane", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(tasks))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    lanes = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    one = side.drop("n").join(hot, key, "left").withColumn("_lane", F.explode(lanes)).drop("_hot")
    # the side's part of a task is hashed, which spares the rows a sort
    return dealt.join(one.hint("shuffle_hash"), [key, "_lane"]).drop("_lane")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): for every id that stands in a link, the smallest id it is connected with.

    Edges are kept as (u, v) with u > v. Large-star joins every larger neighbour of u to u's smallest
    neighbour, small-star every smaller one; the rounds end when the edges no longer change, as stars.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, mark = stage(edges, "edges"), None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, stage(new, "edges")
        unstage(old)
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
