"""Pairs of classes against all pairs of records, and the size of what equal signatures make."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import dedup

SCHEMA = "id long, ord long, sig array<long>"


def signatures():
    """Chains of drifting signatures, each in several copies that arrive in any order."""
    draw = np.random.default_rng(11)
    out = []
    for _ in range(12):
        sig = draw.integers(0, 1 << 30, dedup.PERMUTATIONS)
        for _ in range(6):
            sig = sig.copy()
            sig[draw.choice(dedup.PERMUTATIONS, 9, replace=False)] = draw.integers(0, 1 << 30, 9)
            out += [sig.tolist()] * int(draw.integers(1, 5))
    order = draw.permutation(len(out))
    return [(i, int(order[i]), s) for i, s in enumerate(out)] + [(9000, 9000, []), (9001, 9001, [])]


def test_same_verdicts_as_all_pairs(spark):
    rows = signatures()
    got = dedup.near_pairs(spark.createDataFrame(rows, SCHEMA), 0.85, 32)
    links, scores = {}, {}
    for i, o, s in rows:
        for j, p, t in rows:
            share = float(np.mean(np.array(s) == np.array(t))) if s and t else 0.0
            if p < o and share >= 0.85:
                links.setdefault(i, []).append(j)
                scores[i, j] = share
    first = {}
    for i, o, s in sorted(rows, key=lambda r: r[1]):
        first.setdefault(tuple(s), i)
    firsts = set(first.values())
    want = {(i, j): v for (i, j), v in scores.items() if j in firsts}
    assert {(r.later, r.earlier): r.score for r in got.collect()} == want and len(want) < len(scores)
    order = {i: o for i, o, _ in rows}
    verdict = {}
    for i in sorted(order, key=order.get):
        accepted = [j for j in links.get(i, []) if j not in verdict]
        if accepted:
            verdict[i] = min(accepted, key=lambda j: (-scores[i, j], order[j]))
    assert {r.id: r.duplicate_of for r in dedup.greedy(got).collect()} == verdict


def test_equal_signatures_are_linear(spark):
    sig = F.array(*[F.lit(i).cast("long") for i in range(dedup.PERMUTATIONS)])
    copies = spark.range(10_000).select("id", F.col("id").alias("ord"), sig.alias("sig"))
    found = dedup.near_pairs(copies)
    assert found.count() == 9_999 and [tuple(r) for r in found.select("earlier", "score").distinct().collect()] == [(0, 1.0)]
    assert dedup.near_pairs(copies.filter("id < 0")).count() == 0
