"""Operator 7, toxic passages by maximum-scoring segments.

Training compares how many distinct labelled texts of either class hold a token. Log-odds ratios are
taken with an informative Dirichlet prior (the token's share of all tokens, plus a floor), and a token's
score is the lower confidence bound of its log-odds; tokens without significant evidence share one small
negative score. A linear scan then finds every maximal scoring segment of a text (each segment can't be
extended or cut without losing score). The score of a best segment is turned into a tail probability by
the extreme-value law of such segments, 1 - exp(-K n exp(-lambda S)), with lambda from the scores'
background distribution and K fitted on clean texts; a logistic step on its logarithm makes it the
probability of the label.

Training uses at most ``sample`` labelled documents (by the hash of the id), four fifths for the token
scores and one fifth for the calibration; scoring covers whole texts of all documents.

Nulls: a null text is empty and scores as a text without toxic tokens; null labels and ids don't train.
Repeated rows are scored each; of several labels of an id the largest counts. Without labels of both
classes every score is 0. Empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, remainder, small_batches, table

TOKEN = re.compile(r"\w+")
Z = 2.33
FLOOR, PRIOR = 0.5, 500.0


@dataclass
class Model:
    """Token scores, the score of any other token, and the two calibrations."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    decay: float = 1.0
    k: float = 0.1
    bias: float = -20.0
    slope: float = 0.0

    def surprise(self, best: float, n: int) -> float:
        """-ln of the probability that a clean text of n tokens holds a segment of this score."""
        if best <= 0 or n == 0:
            return 0.0
        e = self.k * n * np.exp(-self.decay * best)
        return float(-np.log(-np.expm1(-e))) if e > 1e-12 else float(-np.log(max(e, 1e-300)))

    def probability(self, best: float, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.surprise(best, n), -50, 50))))


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first token, last token, score), in time linear in the hits.

    ``hits`` are the positions and scores of the positive tokens in order; every token between costs
    ``gap`` (> 0). Each kept segment knows the nearest one before it that starts from a lower sum, so the search
    for one to join skips those that can't be.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before the segment, sum up to its end, lower one before
    total, at = 0.0, -1
    for position, score in hits:
        total -= gap * (position - at - 1)
        first, before = position, total
        total, at = total + score, position
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            first, _, before, _, lower = kept[j]
            del kept[j:]
            j = lower
        kept.append((first, position, before, total, j))
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def hits_of(tokens: list[str], scores: dict[str, float]) -> list[tuple[int, float]]:
    get = scores.get
    return [(i, s) for i, s in enumerate(map(get, tokens)) if s is not None]


def best_segment(tokens: list[str], model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    hits = hits_of(tokens, model.scores)
    found = segments(hits, -model.other) if hits else []
    return max((s for _, _, s in found), default=0.0), found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, label, text) of at most ``sample`` labelled documents, chosen by hash, one row per distinct text."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most `sample` rows of two numbers: a proven bound for the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, max_terms: int = 20_000) -> Model:
    """Learn from ``labels`` (doc_id, toxic), every row of which may train."""
    rows = labelled_sample(docs, labels, "toxic", sample).withColumn("fold", F.pmod(F.xxhash64("h"), F.lit(5)))

    def tokens(batches):
        for batch in batches:
            words, label = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(set(TOKEN.findall((text or "").lower())))
                words += own
                label += [int(y > 0)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(label, pa.int32())], names=["word", "label"])

    counts = (
        map_batches(rows.filter("fold > 0").select("text", "label"), tokens, "word string, label int")
        .groupBy("word").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    )
    counts.persist()
    whole = counts.agg(F.sum("a"), F.sum("b")).first()
    if not whole[0] or not whole[1]:
        counts.unpersist()
        return Model()
    all_a, all_b = whole
    prior = F.lit(FLOOR) + F.lit(PRIOR) * (F.col("a") + F.col("b")) / F.lit(all_a + all_b)
    total = FLOOR + PRIOR
    odds = lambda x, n: F.log((F.col(x) + prior) / (F.lit(n + total) - F.col(x) - prior))
    sd = F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
    scored = counts.withColumn("s", odds("a", all_a) - odds("b", all_b) - F.lit(Z) * sd)
    top = scored.filter("s > 0.05").orderBy(F.desc("s"), F.desc("a"), "word").limit(max_terms).select("word", "s", "a", "b").collect()
    counts.unpersist()
    scores = {r["word"]: r["s"] for r in top}
    a_in, b_in = sum(r["a"] for r in top), sum(r["b"] for r in top)
    other = min(-0.05, float(np.log(max(all_a - a_in, 1) / all_a) - np.log(max(all_b - b_in, 1) / all_b)))
    model = Model(scores, other)
    share = np.array([(r["b"] + FLOOR) / (all_b + FLOOR * len(top)) for r in top])
    size = np.array([r["s"] for r in top])
    if len(top):
        low, high = 1e-6, 50.0  # the positive root of sum p exp(lambda s) = 1
        for _ in range(100):
            mid = (low + high) / 2
            value = (share * np.exp(np.clip(mid * size, None, 600))).sum() + max(0, 1 - share.sum()) * np.exp(mid * other)
            low, high = (mid, high) if value < 1 else (low, mid)
        model.decay = low

    def best(batches):
        for batch in batches:
            n, s = [], []
            for text in batch.column(0).to_pylist():
                words = TOKEN.findall((text or "").lower())
                n.append(len(words))
                s.append(best_segment(words, model)[0])
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(s, pa.float64()), batch.column(1).cast(pa.int64())], names=["n", "s", "label"])

    held = map_batches(rows.filter("fold = 0").select("text", F.col("label").cast("long").alias("label")), best, "n long, s double, label long").collect()
    n, s, y = (np.array([r[k] for r in held], dtype=float) for k in ("n", "s", "label"))
    clean = (y == 0) & (n > 0)
    if clean.any():
        model.k = float(np.clip(clean.sum() / max((n[clean] * np.exp(-model.decay * s[clean])).sum(), 1e-9), 1e-6, 10))
    x = np.array([model.surprise(b, int(m)) for b, m in zip(s, n, strict=True)])
    model.bias, model.slope = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope of a logistic fit of one variable, by Newton's method with a small ridge."""
    design, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0))


def passages(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Score every row: ``keep`` columns, then score, predicted, n_passages, passages (first, last token and score).

    A passage is a maximal segment whose own tail probability is under 5 %.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_terms tokens

    def scan(batches):
        model = shared.value
        for batch in batches:
            score, count, spans = [], [], []
            for text in batch.column(len(keep)).to_pylist():
                words = TOKEN.findall((text or "").lower())
                best, found = best_segment(words, model)
                significant = [{"first": a, "last": b, "score": s} for a, b, s in found if model.surprise(s, len(words)) > 2.9957]
                score.append(model.probability(best, len(words)))
                count.append(len(significant))
                spans.append(significant)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32()), pa.array(count, pa.int32()), pa.array(spans, kind)],
                names=[*[f"c{i}" for i in range(len(keep))], "score", "predicted", "n_passages", "passages"],
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(keep)) + ", score double, predicted int, n_passages int, passages array<struct<first:long,last:long,score:double>>"
    # numbered names: kept columns may have any name, the text's too
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("scanned"))
    return map_batches(wide, scan, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted", "n_passages", "passages")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches):
        model = shared.value
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                words = TOKEN.findall((text or "").lower())
                keep.append(model.probability(best_segment(words, model)[0], len(words)) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(scan, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(remainder(5) > 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = passages(docs, fit(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "n_passages")
