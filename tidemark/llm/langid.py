"""Operator 8, language identification.

Texts become TF-IDF vectors of hashed character 1-, 2- and 3-grams (lower case, white space as one blank).
Document frequencies come from every training row. A sparse multinomial logistic regression is trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of whole texts, at most
``per_language`` of each language by the hash of the id; a fifth of the sample sets the temperature.

Nulls: a text that is null or holds no letter is ``und`` with score 0; rows with null lang or doc_id don't
train. Repeated rows are predicted each. Without training rows every prediction is ``und``. Empty tables
give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, mix64, remainder, table

BITS = 15
SIZE = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
BLANK = re.compile(r"\s+")


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a whole text."""
    flat = " " + BLANK.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    slots = []
    code = points + np.uint64(1)
    for n in range(3):
        if n:
            code = (code[:-1] << np.uint64(21)) | (points[n:] + np.uint64(1))
        slots.append(mix64(code + np.uint64(n << 62)) >> np.uint64(64 - BITS))
    return np.bincount(np.concatenate(slots).astype(np.int64), minlength=SIZE)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the unit TF-IDF vector."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows hold each slot, and how many rows there are; tasks sum their own, Spark sums the tasks."""

    def scan(batches):
        df = np.zeros(SIZE + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[:SIZE] += gram_counts(text or "") > 0
                df[SIZE] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["slot", "n"])

    got = map_batches(rows.select("text"), scan, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SIZE + 1, dtype=np.int64)
    df[got["slot"].to_numpy()] = got["n"].to_numpy()
    return df[:SIZE], int(df[SIZE])


def ftrl(vectors: list, labels: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Follow-the-regularised-leader on the multinomial loss; the weights of (slot, class)."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))
    one = np.eye(classes)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    draw = np.random.default_rng(5)
    for _ in range(epochs):
        for i in draw.permutation(len(vectors)):
            at, x = vectors[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            logits = x @ w
            p = np.exp(logits - logits.max())
            g = np.outer(x, p / p.sum() - one[labels[i]])
            square = ns + g * g
            z[at] = zs + g - (np.sqrt(square) - np.sqrt(ns)) / alpha * w
            n[at] = square
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a grid."""
    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(s)), labels] - np.log(np.exp(s).sum(1))).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
    return float(min(grid, key=loss)) if len(labels) else 1.0


class Model:
    def __init__(self, classes: list[str], idf: np.ndarray | None = None, weights: np.ndarray | None = None, heat: float = 1.0) -> None:
        self.classes, self.idf, self.weights, self.heat = classes, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not LETTER.search(text):
            return "und", 0.0
        at, x = vector(gram_counts(text), self.idf)
        logits = x @ self.weights[at] / self.heat
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        return self.classes[k], float(p[k] / p.sum())


def fit(rows: DataFrame, per_language: int = 1500) -> Model:
    """Learn from ``rows`` (doc_id, text, lang), all of which may train."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(rows)
    ids = rows.select("doc_id", "lang", F.xxhash64("text").alias("h")).filter("doc_id is not null").withColumn("u", F.xxhash64("doc_id"))
    # the lowest hashes of a language lie under a few times its share, so only that many rows are ranked
    share = ids.groupBy("lang").agg(F.count("*").alias("n")).withColumn("most", F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n")))
    low = ids.join(share, "lang").filter((F.col("u").cast("double") + 2.0**63) / 2.0**64 <= F.col("most"))
    order = Window.partitionBy("lang").orderBy("u", "doc_id", "h")
    ids = low.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)
    # at most per_language ids of each language: a proven bound for the broadcast
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def train(batches):
        idf, vectors, names, ids = shared.value, [], [], []
        for batch in batches:
            for i, lang, text in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                vectors.append(vector(gram_counts(text), idf))
                names.append(lang)
                ids.append(i)
        if not names:
            return
        order = sorted(range(len(ids)), key=lambda k: (ids[k], names[k]))
        classes = sorted(set(names))
        labels = np.array([classes.index(x) for x in names])
        held = np.array([mix64(np.array([i & (2**64 - 1)], dtype=np.uint64))[0] % np.uint64(5) == 0 for i in ids])
        fitting, rest = [k for k in order if not held[k]] or order, [k for k in order if held[k]]
        w = ftrl([vectors[k] for k in fitting], labels[fitting], len(classes))
        logits = np.array([vectors[k][1] @ w[vectors[k][0]] for k in rest]).reshape(-1, len(classes))
        heat = temperature(logits, labels[rest])
        at, k = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*[classes[c] for c in k], ""], pa.string()), pa.array([*w[at, k], heat], pa.float64())], names=["slot", "lang", "w"])
        yield pa.RecordBatch.from_arrays([pa.array([-2] * len(classes), pa.int64()), pa.array(classes, pa.string()), pa.array([0.0] * len(classes), pa.float64())], names=["slot", "lang", "w"])

    got = map_batches(sample.select("doc_id", "lang", "text").repartition(1), train, "slot long, lang string, w double").collect()
    classes = sorted({r["lang"] for r in got if r["slot"] != -1})
    weights = np.zeros((SIZE, len(classes)))
    heat = 1.0
    for r in got:
        if r["slot"] >= 0:
            weights[r["slot"], classes.index(r["lang"])] = r["w"]
        elif r["slot"] == -1:
            heat = r["w"]
    return Model(classes, idf, weights, heat)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), scan, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, fit(docs.filter((remainder(4) != 2) & (remainder(4) >= 0))))
    return got.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
