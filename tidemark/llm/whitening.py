"""Operator 13, embedding whitening by digit-slice products.

Entries become integers x = floor(scale * c) + shift. With n vectors and sums S per dimension, d = n * x - S is centred and still an
integer, and the covariance is sum(d d') / n^3. The products are exact: d is split into limbs of 16 bits, the limbs
are multiplied as float64 matrices (a block of at most 2^20 rows stays below 2^53), sums of equal weight are kept as
integers in a task, merged by Spark as decimals, one row for each pair of dimensions and weight, and recombined as big integers. Only
the covariance itself is rounded, once, before its eigenvectors are computed. Whitened vectors are d / n on the eigenvectors, over the
roots of the eigenvalues; d is exact, so they are centred to rounding, and their covariance is measured by one more pass.

The driver holds dimensions x dimensions numbers, never vectors. Four passes read the vectors: sums, products, the check, the result.

Nulls: a vector that is null, or holds a null or non-finite entry, or one beyond 2^55 (its x is no long), is dropped. So are vectors
whose length isn't the most frequent one (ties: the longer), and empty ones. A null id is kept. Repeated rows each count. Components without variance (eigenvalue
below what float64 can tell from 0) aren't given, so vectors that are all equal, or a single one, give no rows. A deviation beyond
a long is null. Columns besides id and vector are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, stage, table

LIMB = 16
SCALE, SHIFT = 64.0, 1_000_000
#: Entries from here on have no x.
FAR = 2.0**55


def integers(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(usable rows, [(their places, x of int64)] for each length) of a list column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.abs(values) < FAR  # false for nan
    begin = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = (sizes > 0) & (bad[begin + sizes] == bad[begin])
    found = []
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        entries = values[begin[rows][:, None] + np.arange(size)]
        found.append((rows, np.floor(entries * SCALE).astype(np.int64) + SHIFT))
    return usable, found


def _of_length(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    for rows, x in integers(column)[1]:
        if x.shape[1] == size:
            return rows, x
    return np.zeros(0, np.int64), np.zeros((0, size), np.int64)


@dataclass(frozen=True)
class Sums:
    """Number of vectors, and per dimension the sum, least and greatest of x."""

    n: int
    total: tuple[int, ...]
    least: tuple[int, ...]
    most: tuple[int, ...]

    @property
    def reach(self) -> int:
        """The greatest |n * x - S|."""
        return max((max(abs(self.n * a - s), abs(self.n * b - s)) for s, a, b in zip(self.total, self.least, self.most, strict=True)), default=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """d = n * x - S, of Python integers where int64 can't hold it."""
        if self.reach < 1 << 62:
            base = np.array([s // self.n for s in self.total], dtype=np.int64)  # n * x alone might not fit
            return (x - base) * self.n - np.array([s % self.n for s in self.total], dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.total, dtype=object)

    @property
    def limbs(self) -> int:
        return max(1, -(-(self.reach.bit_length() + 1) // LIMB))


def sums(vectors: DataFrame) -> Sums | None:
    """Sums over ``vectors`` (id, vector) of the most frequent length, None without any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in integers(batch.column(0))[1]:
                # halves, so that sums of any entries stay within int64
                now = [np.full(x.shape[1], len(x)), (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                old = held.get(x.shape[1])
                held[x.shape[1]] = now if old is None else [*(a + b for a, b in zip(old[:3], now[:3], strict=True)), np.minimum(old[3], now[3]), np.maximum(old[4], now[4])]
        for size, parts in held.items():
            columns = [np.full(size, size), np.arange(size), *parts]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["size", "a", "n", "high", "low", "least", "most"])

    parts = map_batches(vectors.select("vector"), scan, "size long, a long, n long, high long, low long, least long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    merged = parts.groupBy("size", "a").agg(F.sum("n").alias("n"), exact("high").cast("string").alias("high"), exact("low").cast("string").alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
    merged = stage(merged, "sums")
    top = merged.filter("a = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not top:
        return None
    rows = merged.filter(F.col("size") == top[0]["size"]).orderBy("a").collect()
    return Sums(top[0]["n"], tuple(int(r["high"]) * (1 << 31) + int(r["low"]) for r in rows), tuple(r["least"] for r in rows), tuple(r["most"] for r in rows))


def slices(d: np.ndarray, limbs: int) -> list[np.ndarray]:
    """Limbs of ``d`` as float64 matrices, lowest first; the highest is signed."""
    out = []
    for k in range(limbs):
        part = d >> (LIMB * k)
        out.append((part & ((1 << LIMB) - 1) if k + 1 < limbs else part).astype(np.float64))
    return out


def products(d: np.ndarray, limbs: int) -> np.ndarray:
    """Exact sums of products of the columns of ``d`` by weight: result[k] counts 2 ** (LIMB * k) times."""
    out = np.zeros((2 * limbs - 1, d.shape[1], d.shape[1]), dtype=np.int64)
    for at in range(0, len(d), 1 << 20):
        parts = slices(d[at : at + (1 << 20)], limbs)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                out[i + j] += (a.T @ b).astype(np.int64)
    return out


def scatter(vectors: DataFrame, stats: Sums) -> list[list[int]]:
    """sum(d d') over all vectors, as exact integers."""
    size, limbs = len(stats.total), stats.limbs
    up = np.triu_indices(size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * limbs - 1, size, size), dtype=np.int64)
        rows = 0
        for batch in batches:
            x = _of_length(batch.column(0), size)[1]
            held += products(stats.centred(x), limbs)
            rows += len(x)
            if rows > 1 << 26:  # far below what int64 holds
                yield entries(held)
                held[:], rows = 0, 0
        yield entries(held)

    def entries(held: np.ndarray) -> pa.RecordBatch:
        k = np.repeat(np.arange(len(held)), len(up[0]))
        a, b = np.tile(up[0], len(held)), np.tile(up[1], len(held))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (a, b, k, held[k, a, b])], names=["a", "b", "k", "part"])

    merged = map_batches(vectors.select("vector"), scan, "a long, b long, k long, part long").groupBy("a", "b", "k").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out = [[0] * size for _ in range(size)]
    for r in merged.collect():  # dimensions squared times a few weights
        out[r["a"]][r["b"]] += int(r["part"]) << (LIMB * r["k"])
    for a in range(size):
        for b in range(a):
            out[a][b] = out[b][a]
    return out


@dataclass(frozen=True)
class Whitening:
    """What whitens: sums, unit eigenvectors as columns by falling eigenvalue, the eigenvalues and the trace of the covariance."""

    stats: Sums
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, d: np.ndarray) -> pa.Array:
        """The exact sum of squares of each row of ``d``, null beyond a long."""
        if self.stats.reach**2 * d.shape[1] < 1 << 63:
            return pa.array((d.astype(np.int64) ** 2).sum(axis=1))
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def apply(self, d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) / self.stats.n) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """The whitening of ``vectors`` (id, vector) by at most ``most`` components; None if there is no vector."""
    stats = sums(vectors)
    if stats is None:
        return None
    exact, cube = scatter(vectors, stats), stats.n**3
    covariance = np.array([[v / cube for v in row] for row in exact])  # integers are divided with one rounding
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, columns = values[order], columns[:, order]
    told = values > max(values[0], 0.0) * len(values) * np.finfo(float).eps
    kept = min(int(told.sum()) if values[0] > 0 else 0, most)
    trace = sum(exact[a][a] for a in range(len(exact))) / cube
    return Whitening(stats, columns[:, :kept], values[:kept], trace)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over all vectors."""
    size, kept = len(model.stats.total), len(model.values)
    up = np.triu_indices(kept)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, means = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            w = model.apply(model.stats.centred(_of_length(batch.column(0), size)[1]))
            held += w.T @ w
            means += w.sum(axis=0)
        a, b = np.concatenate([up[0], np.arange(kept)]), np.concatenate([up[1], np.full(kept, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([held[up], means]))], names=["a", "b", "part"])

    merged = map_batches(vectors.select("vector"), scan, "a long, b long, part double").groupBy("a", "b").agg(F.sum("part").alias("part")).collect()
    mean, worst = {r["a"]: r["part"] / model.stats.n for r in merged if r["b"] < 0}, 0.0
    for r in merged:
        if r["b"] >= 0:  # the vectors are centred by d already; what rounding left of their mean goes here
            worst = max(worst, abs(r["part"] / model.stats.n - mean[r["a"]] * mean[r["b"]] - (r["a"] == r["b"])))
    return worst


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened: array of double) of every usable vector of ``vectors`` (id, vector)."""
    size = len(model.stats.total)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _of_length(batch.column(1), size)
            d = model.stats.centred(x)
            w = np.ascontiguousarray(model.apply(d))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), model.deviations(d), lists], names=["id", "deviation", "whitened"])

    return map_batches(vectors.select("id", "vector"), scan, f"id {vectors.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def as_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = as_vectors(table(spark, sf_dir, "embeddings"))
    return components(vectors).withColumnRenamed("id", "vec_id")


def components(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    model = fit(vectors, most)
    if model is None or not len(model.values):
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"id {vectors.schema['id'].dataType.simpleString()}, {empty}")
    error = identity_error(vectors, model)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    each = whitened(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "id", (F.col("k") + 1).alias("component"), F.lit(model.stats.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
