"""Operator 2, SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has bit k set if more than half of the text's 3-word shingles have it in their XXH64. For a
radius r every bit position gets a non-zero vector of r + 1 bits; the table of a non-zero vector v looks at
the positions whose vector has an odd product with v. Up to r differing positions span less than r + 1
dimensions, so some v is orthogonal to all of them and its table doesn't see them: every pair within the
radius collides in one of the 2^(r+1) - 1 tables, without exception.

Only distinct fingerprints are dealt, and cells give spanning links, not pairs (see graph.py).

Nulls: a null text is an empty one, with fingerprint zero, linked like any other. A null doc_id is kept and
doesn't count as smallest; a group of null ids alone has a null component. Repeated rows are fingerprinted
each and share a component. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, stage, table, text_bytes
from tidemark.llm.graph import cell_links, collision_cells, components, reach

CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit fingerprint of one whole text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat, n = b" ".join(words), max(len(words) - size + 1, 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:n]
    stops = (ends - 1).tolist()[-n:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(flat[a:b], 42) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): h is the text's XXH64 (null: 42), fp the fingerprint as a long."""

    def scan(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in text_bytes(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fps)], names=["doc_id", "h", "fp"])

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), scan, "doc_id long, h long, fp long")


def covering_masks(radius: int = 3, bits: int = 64, seed: int = 7) -> list[int]:
    """The masks of the covering tables."""
    vectors = 1 + np.random.default_rng(seed).permutation(bits) % ((1 << (radius + 1)) - 1)
    return [sum(1 << i for i in range(bits) if int(vectors[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every component of the radius."""
    tables = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for k, m in enumerate(covering_masks(radius))]
    rows = fps.select(F.explode(F.array(*tables)).alias("key"), F.col("fp").alias("id"))

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        ids = np.array(sorted({r["id"] for r in rows}), dtype=np.int64)
        values = ids.view(np.uint64)
        found = reach(values, lambda m, rest: np.bitwise_count(values[m] ^ values[rest]) <= radius)
        return [(int(ids[a]), int(ids[b])) for a, b in found]

    return cell_links(collision_cells(rows, block), links, ["id"])


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "fps")
    linked = components(near_links(distinct.select("fp"), radius))
    joined = distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = stage(joined, "classes")
    least = joined.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for every row of ``docs``."""
    prints = stage(fingerprints(docs), "prints")
    return prints.join(classes(prints, radius), "fp")


def hex16(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the row of the smallest doc_id stays."""
    found = near_duplicates(docs, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers = stage(found.groupBy("root").agg(F.first("doc_id", True).alias("k_id"), F.min("h").alias("k_h"), F.count("*").alias("n")), "keepers")
    text = F.xxhash64(docs["text"])
    kept = docs.join(keepers, docs["doc_id"].eqNullSafe(keepers["k_id"]) & (text == keepers["k_h"]), "left_semi")
    if keepers.filter("n > 1").limit(1).count():  # repeated rows of one id: one of them stays
        kept = kept.withColumn("k_h", F.xxhash64("text")).dropDuplicates(["doc_id", "k_h"]).drop("k_h")
    return kept


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
