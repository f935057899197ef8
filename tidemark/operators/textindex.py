"""A stored inverted index and ranked full-text search over it.

The index holds a row for each term and block of documents: the documents of the block that have the term, each with the sorted
positions, and the largest frequency in the block. It is partitioned by a bucket of the term and sorted by term, so a
search opens the buckets of its terms and reads their row groups only. Documents are dealt to blocks by a hash, so a term that
every document holds is spread over all blocks, and no row is longer than a block.

Search is for documents that hold all terms. Rank is by nearness: for every two positions of different terms at a distance of at most 100 words
the chance 1 - 0.1 * sqrt(weight(distance)) is multiplied up, and the rank is one minus that; one term alone ranks by its
frequency, 0.1 * (1 + 1/4 + ... + 1/n^2) / 1.644934. Both grow with frequency, so a block's largest frequencies bound the rank of its documents.
The top is found in two steps: blocks of the highest bounds are ranked first, and of the rest only those whose bound reaches the rank that is last among the
top so far. No block that could hold a better document is left out.

Nulls: a null text or id isn't indexed. A query without terms finds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions import text as tx
from tidemark.operators.search import terms

# Fixed values of the rank: weight of a word, width of a pair, and the sum of 1 / n^2.
WEIGHT, NEAR, ALL_SQUARES = 0.1, 100, 1.64493406685
#: Blocks that one task of the index makes, about.
TASK_BLOCKS = 32


def nearness(distance: Column) -> Column:
    """Weight of two words at a distance."""
    return 1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2.0))


def _alone(n: Column) -> Column:
    """Rank of one term that occurs ``n`` times."""
    return WEIGHT * F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), F.lit(0.0), lambda s, k: s + 1.0 / (k * k)) / ALL_SQUARES


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, term, most, docs) of (block, id, key) that come sorted by block: one row for each term of a block, a block at a time."""
    block, held = None, []
    for batch in batches:
        for at, one, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if at != block and held:
                yield _inverted(block, held)
                held = []
            block = at
            held.append((one, key))
    if held:
        yield _inverted(block, held)


def _inverted(block: int, held: list[tuple[pa.Scalar, str]]) -> pa.RecordBatch:
    found: dict[str, dict[int, list[int]]] = defaultdict(dict)
    for k, (_, key) in enumerate(held):
        for place, word in enumerate(key.split()):
            found[word].setdefault(k, []).append(place)
    which = [k for docs in found.values() for k in docs]
    lists = [positions for docs in found.values() for positions in docs.values()]
    ids = pa.array([one.as_py() for one, _ in held], held[0][0].type).take(pa.array(which, pa.int64()))
    docs = pa.StructArray.from_arrays([ids, pa.array(lists, pa.list_(pa.int32()))], names=["id", "positions"])
    ends = [0, *accumulate(len(d) for d in found.values())]
    most = [max(map(len, d.values())) for d in found.values()]
    columns = [pa.array([block] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(most, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "term", "most", "docs"])


class TextIndex:
    """The index in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.settings = tables.get_json(spark, f"{self.folder}/index.json")
        self.schema = f"bucket int, term string, block long, most long, docs array<struct<id:{self.settings['id']},positions:array<int>>>"

    @classmethod
    def create(cls, docs: DataFrame, folder: str, buckets: int = 64, block: int = 128) -> TextIndex:
        """Index ``docs`` (id, text); a block has about ``block`` documents, a bucket a file of each task."""
        spark = docs.sparkSession
        blocks = max(1, -(-docs.count() // block))
        kind = dict(docs.dtypes)["id"]
        # the texts are shuffled once, to their blocks; what a block makes is bounded by it and goes to the files where it is;
        # tasks grow in number with the blocks, not in size, so what they sort stays in memory
        dealt = docs.filter("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "text").repartition(-(-blocks // TASK_BLOCKS), "block").sortWithinPartitions("block")
        rows = dealt.select("block", "id", tx.canonical_key(F.col("text")).alias("key")).mapInArrow(inverted, f"block long, term string, most long, docs array<struct<id:{kind},positions:array<int>>>")
        tables.put_json(spark, f"{folder.rstrip('/')}/index.json", {"buckets": buckets, "id": kind})
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        bucketed.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder.rstrip('/')}/postings")
        return cls(spark, folder)

    def postings(self, words: list[str]) -> DataFrame:
        """The rows of some terms; only their buckets are opened."""
        hits = self.spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(self.settings["buckets"])).cast("int"))
        buckets = sorted({r[0] for r in hits.collect()})
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    def bounds(self, words: list[str]) -> DataFrame:
        """(block, bound): blocks that hold all terms, and what no rank in them exceeds; reads no document list."""
        most = self.postings(words).groupBy("block").agg(F.count("*").alias("held"), F.sum("most").alias("s"), F.sum(F.col("most") * F.col("most")).alias("q"), F.max("most").alias("top"))
        best = math.sqrt(1.0 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2.0)))
        # as many pairs as there are, all side by side
        pairs = (F.col("s") * F.col("s") - F.col("q")) / 2
        bound = _alone(F.col("top")) if len(words) == 1 else 1 - F.pow(F.lit(1 - WEIGHT * best), pairs)
        return most.filter(F.col("held") == len(words)).select("block", bound.alias("bound"))

    def ranked(self, words: list[str], blocks: DataFrame) -> DataFrame:
        """(id, score) of the documents of ``blocks`` (block) that hold all terms."""
        each = self.postings(words).join(blocks.select("block"), "block", "left_semi").select("term", F.inline("docs"))
        if len(words) == 1:
            return each.select("id", F.round(_alone(F.size("positions")), 6).alias("score"))
        # a document's rows of the terms: few and bounded by the query
        whole = each.groupBy("id").agg(F.count("*").alias("held")).filter(F.col("held") == len(words)).select("id")
        flat = each.join(whole, "id", "left_semi").select("id", "term", F.explode("positions").alias("at"))
        # two positions at most NEAR apart lie in the same or neighbouring stretches of NEAR words
        left = flat.select("id", F.col("term").alias("a"), F.col("at").alias("x"), F.floor(F.col("at") / NEAR).alias("stretch"))
        right = flat.select("id", F.col("term").alias("b"), F.col("at").alias("y"), F.explode(F.array(*[F.floor(F.col("at") / NEAR) + k for k in (-1, 0, 1)])).alias("stretch"))
        apart = F.abs(F.col("x") - F.col("y"))
        pairs = left.join(right, ["id", "stretch"]).filter((F.col("a") < F.col("b")) & (apart <= NEAR))
        summed = pairs.groupBy("id").agg(F.sum(F.ln(1 - WEIGHT * F.sqrt(nearness(apart)))).alias("log"))
        return whole.join(summed, "id", "left").select("id", F.round(1 - F.exp(F.coalesce("log", F.lit(0.0))), 6).alias("score"))

    def search(self, query: str, limit: int = 25, first: int = 16) -> DataFrame:
        """(place, id, score): the best ``limit`` documents of a query, ties by id; ``first`` blocks are ranked before others are skipped."""
        words = sorted(set(terms(query)))
        if not words:
            return self.spark.createDataFrame([], f"place int, id {self.settings['id']}, score double")
        top = lambda df: df.orderBy(F.desc("score"), "id").limit(limit)
        blocks, _ = self.open_blocks(words, limit, first)
        order = Window.orderBy(F.desc("score"), "id")  # over the top only
        return top(self.ranked(words, blocks)).select(F.row_number().over(order).alias("place"), "id", "score")

    def open_blocks(self, words: list[str], limit: int, first: int) -> tuple[DataFrame, DataFrame]:
        """(blocks that have to be ranked, all blocks that hold the terms)."""
        bounds = tables.stage(self.bounds(words), "bounds")
        begin = bounds.orderBy(F.desc("bound"), "block").limit(first)
        best = self.ranked(words, begin).orderBy(F.desc("score"), "id").limit(limit).collect()  # ``limit`` rows
        last = best[-1]["score"] if len(best) == limit else -1.0
        return bounds.filter(F.col("bound") >= last - 1e-6).unionByName(begin).select("block").distinct(), bounds
