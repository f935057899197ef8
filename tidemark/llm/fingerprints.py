"""Operator 5, document fingerprints by weighted SimHash. DataFrame functions only.

A text's terms are its words each with the word after it, hashed together; a term weighs as many votes as
its first word has bytes, at most 32. Bit k of the fingerprint is set if more than half of all votes have
it. Votes of bits k and k + 32 are summed in one long (a text has under 2^31 bytes, so neither half can
overflow). ``within_radius`` finds all fingerprints at a Hamming distance by permuted block tables.

``with_next`` puts each document beside the next one in descending order of doc_id: ids are cut into ranges
of about equal size, a range is a window, and every range also gets the first document of the next range, so
the texts are shuffled once and no window holds more than its range.

Nulls: a null text is an empty one, with fingerprint zero; a null doc_id comes last in the order. Repeated
rows each have a place in the order (ties by a hash of the text). A table of one row is its own next. Empty
tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import ranges
from tidemark.llm.common import table
from tidemark.llm.graph import collision_cells
from tidemark.llm.simhash import hex16, signed

RADIUS = 3
ROWS_OF_A_RANGE = 1000


def voted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and fp (long) of each distinct combination of keys; rows of equal keys vote together."""
    words = rows.withColumn("_w", F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"))
    pairs = words.select(*keys, F.inline_outer(F.arrays_zip("_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("_x"))).alias("_word", "_after"))
    term = pairs.select(
        *keys,
        F.xxhash64("_word", F.coalesce("_after", F.lit(""))).alias("_h"),
        F.coalesce(F.least(F.octet_length("_word"), F.lit(32)), F.lit(0)).cast("long").alias("_v"),
    )
    lanes = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(0x100000001)) * F.col("_v")).alias(f"_s{k}") for k in range(32)]
    summed = term.groupBy(*keys).agg(*lanes, F.sum("_v").alias("_all"))
    bits = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"_s{k}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("_all"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("_all"), F.lit(signed(1 << (k + 32))).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, bits.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def with_next(docs: DataFrame, rows_of_a_range: int = ROWS_OF_A_RANGE) -> DataFrame:
    """(range, place, extra, doc_id, text, next_text) of ``docs`` (doc_id, text without nulls).

    Rows with ``extra`` 1 repeat the first document of the next range at the end of each.
    """
    cuts = ranges.bounds(docs, "doc_id", -(-docs.count() // rows_of_a_range))
    ranged = docs.select(ranges.bucket(F.col("doc_id"), cuts).alias("range"), "doc_id", "text", F.xxhash64("text").alias("h"))
    # one narrow row per range (at most ranges.MOST): its first document in descending order
    firsts = ranged.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("nh"))).alias("m")).select(F.col("range").alias("f_range"), F.col("m.doc_id").alias("f_id"), F.bitwise_not(F.col("m.nh")).alias("f_h"))
    order = Window.orderBy("f_range")
    users = firsts.withColumn("user", F.coalesce(F.lead("f_range").over(order), F.min("f_range").over(Window.partitionBy())))  # the range above ends with it
    donors = ranged.join(F.broadcast(users), (ranged["range"] == F.col("f_range")) & ranged["doc_id"].eqNullSafe(F.col("f_id")) & (ranged["h"] == F.col("f_h")))
    donors = donors.dropDuplicates(["user"]).select(F.col("user").alias("range"), F.lit(1).alias("extra"), "doc_id", "h", "text")
    rows = ranged.select("range", F.lit(0).alias("extra"), "doc_id", "h", "text").unionByName(donors)
    down = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "h")
    return rows.select("range", F.row_number().over(down).alias("place"), "extra", "doc_id", "text", F.lead("text").over(down).alias("next_text"))


def edited_likeness(docs: DataFrame, rows_of_a_range: int = ROWS_OF_A_RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last third is the start of the next document."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows_of_a_range)
    n = F.char_length("text").cast("long")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n.cast("int") - k), F.substr("next_text", F.lit(1), k))
    named = rows.select("range", "place", "extra", "doc_id", n.alias("n_chars"), "text", F.when(F.col("extra") == 0, edited).alias("edited"))
    both = named.select(
        "range", "place", "extra", "doc_id", "n_chars",
        F.inline(F.array(
            F.struct(F.lit(0).alias("which"), F.lit("").alias("sha"), F.col("text").alias("body")),
            F.struct(F.lit(1).alias("which"), F.sha2(F.col("edited"), 256).alias("sha"), F.col("edited").alias("body")),
        )),
    ).filter("body is not null")
    keys = ["range", "place", "extra", "doc_id", "n_chars"]
    prints = voted(both, [*keys, "which", "sha"], "body")
    wide = prints.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"),
        F.max(F.when(F.col("which") == 1, F.col("sha"))).alias("edited_sha256"),
    )
    wide = wide.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("range").orderBy("place"))).filter("extra = 0")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def block_masks(radius: int = RADIUS, blocks: int = 6) -> list[int]:
    """One mask for each choice of ``blocks - radius`` of the blocks that 64 bits are cut into.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so they agree on a whole choice.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def within_radius(prints: DataFrame, radius: int = RADIUS, block: int = 256) -> DataFrame:
    """(a, b, distance), a < b: every pair of distinct fingerprints (column fp) within the radius, once."""
    tables = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for k, m in enumerate(block_masks(radius))]
    rows = prints.select("fp").distinct().select(F.explode(F.array(*tables)).alias("key"), F.col("fp").alias("id"))
    cells = collision_cells(rows, block)
    left, right = cells.withColumnRenamed("id", "a"), cells.withColumnRenamed("id", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, ["key", "i", "j"]).filter((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance")).distinct()


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
