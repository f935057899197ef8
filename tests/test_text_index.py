"""Ranked search through the stored index against the rule on plain lists."""

import math
import random

from tidemark import tables
from tidemark.functions.keys import canonical_key_of
from tidemark.operators.textindex import TextIndex


def rank(text, words):
    tokens = canonical_key_of(text).split()
    at = {w: [k for k, t in enumerate(tokens) if t == w] for w in words}
    if not all(at.values()):
        return None
    if len(words) == 1:
        return round(0.1 * sum(1 / k**2 for k in range(1, len(at[words[0]]) + 1)) / 1.64493406685, 6)
    none = 1.0
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            for x in at[a]:
                for y in at[b]:
                    if abs(x - y) <= 100:
                        none *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
    return round(1 - none, 6)


def test_search(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([5, 40, 300])))) for k in range(400)]
    docs += [(400, None), (401, ""), (402, "Wörld w1 W2"), (403, "w1 " + "x " * 250 + "w2"), (None, "w1 w2")]
    index = TextIndex.create(spark.createDataFrame(docs, "id long, text string"), tables.fresh(spark, "text"), buckets=8, block=8)
    for query in ("w1", "w2 w1", "w40 w3 W50", "world", "w1 nowhere", "", "w7 w7"):
        asked = sorted(set(canonical_key_of(query).split()))
        want = sorted(((-s, i) for i, t in docs if i is not None and asked and (s := rank(t or "", asked)) is not None))[:10]
        got = [(-r["score"], r["id"]) for r in index.search(query, 10, 4).orderBy("place").collect()]
        assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want, strict=True)), query
    # blocks are skipped, and only the buckets of the terms are opened
    open_blocks, every = index.open_blocks(["w1"], 3, 4)
    assert 0 < open_blocks.count() < every.count() / 2
    plan = index.postings(["w1"])
    plan.collect()
    leaf = plan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numPartitions").value() == 1
    assert "docs" not in index.bounds(["w1"])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
