"""Operator 1, quality classifier on document statistics.

Each text becomes a vector of statistics (lengths, character classes, repetition). Random Fourier features
of the standardised statistics approximate a Gaussian kernel; the normal equations of a ridge regression
are summed within partitions and then over partitions; isotonic regression on held-back training rows
turns the ridge score into a probability.

At most ``sample`` labelled documents (by the hash of the id) train, a fifth of them the calibration.
Statistics are computed once, staged, and serve training and scoring.

Nulls: a null text is an empty text, whose statistics are zero; null labels and ids don't train. Repeated
rows are scored each; of several labels of an id the largest counts. Without labels every score is 0.5.
Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, remainder, stage, table, text_bytes

NAMES = (
    "log_words", "log_chars", "word_mean", "word_sd", "upper", "digit", "punct", "symbol", "pipe", "bang",
    "non_ascii", "distinct_words", "top_word", "short_words", "word_end_symbol", "upper_words", "log_lines",
    "repeated_lines", "repeated_trigrams", "line_mean", "sentence_end", "comma",
)
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{|}~", dtype=np.uint8)


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n_bytes, n = len(text), len(words)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    upper = counts[65:91].sum()
    letters = upper + counts[97:123].sum() + counts[128:].sum()
    punct = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    lower = text.lower().split()
    seen = Counter(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = list(zip(lower, lower[1:], lower[2:], strict=False))
    ends = Counter(w[-1] for w in words)
    symbol_ends = sum(c for b, c in ends.items() if b in b"#$%&*|!~^+=@")
    return [
        np.log1p(n), np.log1p(n_bytes), sizes.mean(), sizes.std(), upper / max(letters, 1), counts[48:58].sum() / n_bytes,
        punct / n_bytes, counts[_SYMBOLS].sum() / n_bytes, counts[124] / n, counts[33] / n, counts[128:].sum() / n_bytes,
        len(seen) / n, max(seen.values()) / n, (sizes <= 3).sum() / n, symbol_ends / n, sum(w.isupper() for w in words) / n, np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), 1 - len(set(grams)) / len(grams) if grams else 0.0, np.log1p(n / len(lines)),
        ends[46] / n, ends[44] / n,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) for every row of ``docs``."""

    def scan(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in text_bytes(batch)], dtype=np.float64).reshape(-1, len(NAMES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), scan, "doc_id long, x array<double>")


class Fourier:
    """Standardise, then cos(W x + b) with fixed random W and b: an approximate Gaussian kernel."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, size: int = 256, width: float = 3.0, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.sd, self.size = mean, np.where(sd > 1e-9, sd, 1.0), size
        self.w = draw.normal(size=(len(mean), size)) / width
        self.b = draw.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.hstack([np.sqrt(2 / self.size) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (score, probability) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # one row's worth of doubt keeps both ends off 0 and 1
    knots = np.array([[c / b, (a + 0.5 * (a in (0, b))* (1 if a == 0 else -1)) / b] for a, b, c in blocks])
    return knots[:, 0], np.maximum.accumulate(np.clip(knots[:, 1], 0, 1))


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sum z z' and z y over ``rows`` (x, label): each partition sums its own, Spark sums the partitions."""
    shared = rows.sparkSession.sparkContext.broadcast(fourier)

    def scan(batches):
        fourier = shared.value
        m = fourier.size + 1
        a, b = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float)
            if len(x):
                z = fourier(x)
                a += z.T @ z
                b += z.T @ np.array(batch.column(1).to_pylist(), dtype=float)
        full = np.hstack([a, b[:, None]])
        cells = np.arange(full.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(full.ravel())], names=["cell", "v"])

    summed = map_batches(rows.select("x", "label").coalesce(8), scan, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    m = fourier.size + 1
    flat = np.zeros(m * (m + 1))
    flat[summed["cell"].to_numpy()] = summed["v"].to_numpy()
    full = flat.reshape(m, m + 1)
    return full[:, :m], full[:, m]


class Model:
    """Ridge weights on Fourier features and the isotonic knots; without training, 0.5 for all."""

    def __init__(self, fourier: Fourier | None = None, weights: np.ndarray | None = None, knots: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # the last thousandth keeps the order of scores within a level of the isotonic step
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))


def fit(rows: DataFrame, labels: DataFrame, sample: int = 20_000, ridge: float = 1e-2) -> Model:
    """Learn from ``rows`` (doc_id, x) and ``labels`` (doc_id, quality), every row of which may train."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most `sample` rows of two numbers: a proven bound for the broadcast
    known = rows.join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)))
    train = known.filter("fold > 0")
    at = [F.col("x")[i] for i in range(len(NAMES))]
    moments = train.agg(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at], F.avg("label")).first()
    if not moments[0]:
        return Model()
    fourier = Fourier(np.array(moments[1 : 1 + len(at)], dtype=float), np.array(moments[1 + len(at) : -1], dtype=float))
    a, b = normal_equations(train, fourier)
    weights = np.linalg.solve(a + ridge * np.eye(len(a)), b)
    model = Model(fourier, weights)
    held = known.filter("fold = 0").select("x", "label").orderBy("label", "doc_id").toArrow()
    if held.num_rows == 0:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return model
    model.knots = isotonic(model.raw(np.array(held["x"].to_pylist(), dtype=float)), held["label"].to_numpy())
    return model


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``rows`` (doc_id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x), pa.float64())], names=["doc_id", "score"])

    return map_batches(rows.select("doc_id", "x"), scan, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(features(table(spark, sf_dir, "documents")), "quality")
    model = fit(rows, table(spark, sf_dir, "labels").filter((remainder(3) != 1) & (remainder(3) >= 0)))
    scored = scores(rows, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
