"""Duplicates of records: natural key, then URL, then content, then near (MinHash bands), the first match wins.

``ord`` is a total order of arrival. A record is a near-duplicate if an earlier record that itself is accepted
is similar enough; chains are resolved by rounds over staged verdicts, never on the driver.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark import tables

PERMUTATIONS, BANDS, PRIME = 128, 16, (1 << 31) - 1
TOKEN, URL = re.compile(r"[a-z0-9][a-z0-9+#.\-_/]*"), re.compile(r"https?://\S+")


@lru_cache
def _coefficients(seed: int = 0x5EED) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(1, PRIME, PERMUTATIONS, dtype=np.uint64), draw.integers(0, PRIME, PERMUTATIONS, dtype=np.uint64)


#: Hashes that are permuted at one time.
STEP = 256


def least(hashes: np.ndarray) -> np.ndarray:
    """128 minima of linear permutations of 31-bit hashes, of which there is one at least; STEP of them at a time, however long the text."""
    (a, b), prime, bits = _coefficients(), np.uint64(PRIME), np.uint64(31)
    found = np.full(PERMUTATIONS, PRIME, np.uint64)
    for at in range(0, len(hashes), STEP):
        x = hashes[at : at + STEP].astype(np.uint64)[:, None] * a
        x += b
        for _ in range(2):  # the remainder by 2^31 - 1: what is above 31 bits is added to what is below, until it is the prime at most
            high = x >> bits
            x &= prime
            x += high
        x[x == prime] = 0
        np.minimum(found, x.min(axis=0), out=found)
    return found.astype(np.int64)


def minima(hashes: np.ndarray) -> list[int]:
    """The same as a list; empty for no hashes."""
    return least(hashes).tolist() if len(hashes) else []


def shingle_hashes(value: str | None, size: int = 5) -> np.ndarray:
    """31-bit hashes of the distinct token runs of a text."""
    import xxhash

    found = (t.strip("._-/") for t in TOKEN.findall(URL.sub(" ", (value or "").lower())))
    tokens = [t for t in found if t]
    runs = set(tokens) if len(tokens) <= size else set(map(" ".join, zip(*(tokens[i:] for i in range(size)), strict=False)))
    return np.array([*map(xxhash.xxh64_intdigest, runs)], dtype=np.uint64) & np.uint64(PRIME)


def _signatures(values: pa.Array) -> pa.Array:
    """MinHash signature of a text; arrays of lambdas can't be vectorised in the JVM, an Arrow batch can in NumPy.

    A batch stays in Arrow: one text at a time is a Python object, and signatures are rows of one NumPy array.
    """
    found, ends = np.empty((len(values), PERMUTATIONS), np.int64), [0]
    for value in values:
        hashes = shingle_hashes(value.as_py())
        if len(hashes):
            found[ends[-1] // PERMUTATIONS] = least(hashes)
        ends.append(ends[-1] + (PERMUTATIONS if len(hashes) else 0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[: ends[-1] // PERMUTATIONS].reshape(-1)))


#: Kept where it stands: as one that isn't deterministic, so that a filter over signatures doesn't compute them a second time.
signature = F.arrow_udf(_signatures, ArrayType(LongType())).asNondeterministic()


def similarity(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for signatures of different length or none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def exact_jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def band_keys(sig: Column, bands: int = BANDS) -> Column:
    rows = PERMUTATIONS // bands
    return F.when(F.size(sig) > 0, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(sig, i * rows + 1, F.lit(rows))))).otherwise(F.array().cast("array<bigint>"))


def near_pairs(signed: DataFrame, threshold: float = 0.85, bands: int = BANDS) -> DataFrame:
    """(later, earlier, score, ord) of records (id, ord, sig): each later record with the earlier *first* records of the signatures near its own.

    Records of one signature are one class, which its first record stands for: of any number of equal signatures each gives one row for each near
    class, not one for each near record. ``greedy`` decides alike on these and on all pairs: a record after the first of its class is
    never accepted, since whatever is near to it is near to the first. Bands are joined over classes, of which each near pair is scored once.
    Signatures without values are near to nothing.
    """
    rows = tables.stage(signed.filter(F.size("sig") > 0).select("id", "ord", "sig", F.sha2(F.array_join("sig", ","), 256).alias("class")), "signed")  # read twice: texts are signed once
    classes = tables.stage(rows.groupBy("class").agg(F.first("sig").alias("sig"), F.min_by("id", "ord").alias("earlier"), F.min("ord").alias("o2")), "classes")
    keyed = classes.select("class", F.explode(band_keys(F.col("sig"), bands)).alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    narrow = keyed.join(shared, "band")
    pairs = narrow.select("band", F.col("class").alias("a")).join(narrow.select("band", F.col("class").alias("b")), "band").filter("a < b").select("a", "b").distinct()
    sigs = classes.select("class", "sig")
    scored = pairs.join(sigs.toDF("a", "s1"), "a").join(sigs.toDF("b", "s2"), "b").withColumn("score", similarity(F.col("s1"), F.col("s2"))).filter(F.col("score") >= threshold)
    near = tables.stage(scored.select("a", "b", "score"), "near")
    own = F.lit(1.0).cast("double")
    links = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(classes.select(F.col("class").alias("a"), F.col("class").alias("b"), own.alias("score")))
    firsts = links.join(classes.select(F.col("class").alias("b"), "earlier", "o2"), "b").select(F.col("a").alias("class"), "earlier", "o2", "score")
    return rows.select("class", F.col("id").alias("later"), F.col("ord").alias("o1")).join(firsts, "class").filter("o2 < o1").select("later", "earlier", "score", F.col("o2").alias("ord"))


def exact_verdicts(records: DataFrame) -> DataFrame:
    """``records`` (id, ord, natural_key, url_fingerprint, content_hash) with kind and duplicate_of by exact keys.

    The first id of a key is found by aggregation and joined back, so a hot key is never one window.
    """
    out = records
    for name, key in (("exact_source", "natural_key"), ("url", "url_fingerprint"), ("content", "content_hash")):
        firsts = records.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min_by("id", "ord").alias(f"_{name}"))
        out = out.join(firsts, key, "left")
    hit = lambda n: F.col(f"_{n}").isNotNull() & (F.col(f"_{n}") != F.col("id"))
    kind = F.when(hit("exact_source"), "exact_source").when(hit("url"), "url").when(hit("content"), "content")
    of = F.when(hit("exact_source"), F.col("_exact_source")).when(hit("url"), F.col("_url")).when(hit("content"), F.col("_content"))
    return out.select(*records.columns, kind.alias("kind"), of.alias("duplicate_of"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    folder = tables.shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def greedy(pairs: DataFrame) -> DataFrame:
    """(id, duplicate_of, score): records with an accepted earlier neighbour; the best scoring one, then the earliest.

    Settled records leave the table each round: accepted are those without an open earlier neighbour.
    The earliest open record always settles, so the rounds end, and only when none is open.
    """
    pairs = pairs.persist()
    nodes = pairs.select(F.col("later").alias("id")).union(pairs.select("earlier")).distinct()
    verdict = nodes.join(pairs.select(F.col("later").alias("id")), "id", "left_anti").withColumn("dup", F.lit(False))
    while True:
        state = pairs.join(verdict.select(F.col("id").alias("earlier"), "dup"), "earlier", "left")
        told = state.groupBy(F.col("later").alias("id")).agg(F.bool_or(~F.coalesce("dup", F.lit(True))).alias("has"), F.bool_and(F.coalesce("dup", F.lit(False))).alias("free"))
        new = told.filter("has OR free").select("id", F.col("has").alias("dup"))
        base = nodes.join(pairs.select(F.col("later").alias("id")), "id", "left_anti").withColumn("dup", F.lit(False))
        new = _checkpointed(base.unionByName(new))
        if new.count() == verdict.count():
            verdict = new
            break
        verdict = new
    accepted = verdict.filter("NOT dup").select(F.col("id").alias("earlier"))
    best = pairs.join(accepted, "earlier").join(verdict.filter("dup").select(F.col("id").alias("later")), "later")
    return best.groupBy(F.col("later").alias("id")).agg(F.min_by(F.struct("earlier", "score"), F.struct(-F.col("score"), F.col("ord"))).alias("b")).select("id", F.col("b.earlier").alias("duplicate_of"), F.col("b.score").alias("score"))


def dedup(records: DataFrame, threshold: float = 0.85, bands: int = BANDS) -> DataFrame:
    """Records (id, ord, natural_key, url_fingerprint, content_hash, text) with kind, duplicate_of and score."""
    exact = exact_verdicts(records)
    unique = exact.filter("kind IS NULL").select("id", "ord", signature(F.col("text")).alias("sig"))
    near = greedy(near_pairs(unique, threshold, bands)).withColumnRenamed("duplicate_of", "_of")
    joined = exact.join(near, "id", "left")
    return joined.withColumn("kind", F.coalesce("kind", F.when(F.col("_of").isNotNull(), "near"))).withColumn("duplicate_of", F.coalesce("duplicate_of", "_of")).drop("_of")


def statistics(verdicts: DataFrame) -> DataFrame:
    """(kind, n, rate) over all checked records; kind 'unique' for the rest."""
    total = verdicts.agg(F.count("*").alias("total"))
    found = verdicts.groupBy(F.coalesce("kind", F.lit("unique")).alias("kind")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(total)).select("kind", "n", (F.col("n") / F.col("total")).alias("rate"))
