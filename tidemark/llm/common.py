"""What several operators share: tables, shared staging folder, Arrow batches, tokens and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch handed to Python; long texts make batches of a few MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Shuffle files go when the write that made them has ended, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, tag: str, dictionary: bool = True) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; without ``dictionary`` where nearly all values differ.

    Cuts the lineage, so a lost executor costs a re-read and never a recomputation of what stands before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def small_batches(df: DataFrame) -> DataFrame:
    """Bound what one Arrow batch holds: the session hands Python BATCH_ROWS rows at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return small_batches(df).mapInArrow(function, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of batches that arrive sorted by ``keys``, a group at a time."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each word; ``cache`` keeps those of frequent words and is emptied when large."""
    import xxhash

    if len(cache) > 200_000:
        cache.clear()
    digest, get = xxhash.xxh3_64_intdigest, cache.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = digest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k])
    return out


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, the same for A-Z and a-z.
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 16


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = powers(_BASE, 2 * _PIECE), powers(pow(_BASE, -1, 1 << 64), 2 * _PIECE)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, firsts) of a string column: a 64-bit hash of each lower-case (A-Z) word of all rows in a row, and
    the number of words before each row, one more at the end; null has no words.

    A word's hash is a polynomial of its bytes, taken from running sums over pieces of the column's bytes.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = at + _PIECE
        if stop < len(data):  # on to the next white space or text
            text = int(offsets[np.searchsorted(offsets, stop)])
            while stop < text:
                space = np.flatnonzero(_SPACE[data[stop : min(stop + 4096, text)]])
                if len(space):
                    stop += int(space[0])
                    break
                stop = min(stop + 4096, text)
        part = data[at:stop]
        inside = ~_SPACE[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + len(part))] - at
        first[heads], last[heads - 1] = inside[heads], inside[heads - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = (_UP, _DOWN) if len(part) <= len(_UP) else (powers(_BASE, len(part)), powers(pow(_BASE, -1, 1 << 64), len(part)))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        starts.append(a + at)
        at += len(part)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)
