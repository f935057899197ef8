"""Operator 4, benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct 5-word shingles (powers of two). An item's sketch is
its k smallest shingle hashes, k = floor((1 - t) u) + 1 for the upper size u of its partition: a text that
holds a share t of the item's shingles lacks fewer than k of them, so it holds a sketch hash for certain.
A text of any length is probed with all its shingles, its candidates are verified by exact containment on
the shingles themselves.

Items come in blocks of bounded size; each block is one pass over the texts, so a benchmark of any size is
served with bounded memory. Lower case A-Z; words are split at ASCII white space; an item of under
five words is one shingle, looked for among the runs of as many words.

Nulls: null texts hold nothing, null or empty items match nothing. Repeated rows are searched each; an item
that occurs twice is found under both ids. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, shingle_hashes, table, text_bytes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of item texts that one pass may hold in each task.
BLOCK_BYTES = 16_000_000


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Block:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float, size: int = SHINGLE) -> None:
        self.threshold, self.ids, self.lengths, self.sets = threshold, [], [], []
        keys, owners, cache = [], [], {}
        for item, text in items:
            words = text.lower().split()
            if not words:
                continue
            length = min(size, len(words))
            hashes = np.unique(shingle_hashes(word_hashes(words, cache), length))
            upper = 1 << (len(hashes) - 1).bit_length()
            k = min(math.floor((1 - threshold) * upper + 1e-9) + 1, len(hashes))
            keys.append(hashes[:k])
            owners.append(np.full(k, len(self.ids)))
            self.ids.append(item)
            self.lengths.append(length)
            self.sets.append(shingles(words, length))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.owners = key[order], owner[order].astype(np.int64)

    def search(self, text: bytes, cache: dict[bytes, int]) -> list[tuple[int, int, int]]:
        """(item id, shingles found, shingles) of each item that the text contains."""
        words = text.lower().split()
        if not words or not self.ids:
            return []
        hashes, out = word_hashes(words, cache), []
        for length in sorted(set(self.lengths)):
            if len(words) < length:
                continue
            own = shingle_hashes(hashes, length)
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = np.unique(own[self.keys[at] == own])
            if not len(hit):
                continue
            low, high = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
            candidates = {int(o) for a, b in zip(low, high, strict=True) for o in self.owners[a:b]}
            grams = None
            for c in sorted(candidates):
                if self.lengths[c] == length:
                    grams = shingles(words, length) if grams is None else grams
                    found = len(self.sets[c] & grams)
                    if found >= self.threshold * len(self.sets[c]) - 1e-9:
                        out.append((self.ids[c], found, len(self.sets[c])))
        return out


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, item_id, n_found, n_shingles, containment): every item that a text contains; h is the text's XXH64."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = Block([(r[0], r[1].encode()) for r in part.collect()], threshold)  # about BLOCK_BYTES
        one = _search(docs, block)
        found = one if found is None else found.unionByName(one)
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def _search(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        block, cache = shared.value, {}
        for batch in batches:
            rows = []
            ids, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, h, text in zip(ids, hs, text_bytes(batch), strict=True):
                rows += [(i, h, *x) for x in block.search(text, cache)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["doc_id", "h", "item_id", "n_found", "n_shingles"])

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), scan, "doc_id long, h long, item_id long, n_found long, n_shingles long")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text contains no item."""
    hits = contained(docs, benchmark, threshold).select(F.col("h").alias("hit_h")).distinct()
    return docs.join(hits, F.xxhash64(docs["text"]) == F.col("hit_h"), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_found", "n_shingles", "containment")
