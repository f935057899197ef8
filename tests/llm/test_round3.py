"""Sharding, spelling variants and whitening against brute force on small tables."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import sharding, spelling, whitening

SF = "/root/testdata/sf0.001"


def smallest_capacity(sizes, shards):
    """Smallest largest sum over contiguous partitions, by dynamic programming."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = [int(e) for e in ends]
    for _ in range(shards - 1):
        best = [min(max(best[k], int(ends[n] - ends[k])) for k in range(n + 1)) for n in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_minimax_is_exact(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "FINER_BITS", 2)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)]
    keys += [keys[0] + 1, keys[0] + 2]
    rows = [(k, rng.choice([1, 5, 40])) for k in keys for _ in range(rng.choice([1, 1, 3]))]
    if seed % 2:
        rows += [(keys[7], 30)] * 40  # a group beyond its share
    groups = Counter()
    for k, s in rows:
        groups[k] += s
    sizes = [groups[k] for k in sorted(groups)]
    cuts = sharding.minimax(spark.createDataFrame(rows, "key long, size long"), 8)
    assert cuts.capacity == smallest_capacity(sizes, 8)
    found = spark.createDataFrame(rows, "key long, size long").withColumn("shard", cuts.shard(sharding.F.col("key"))).collect()
    filled = Counter()
    for r in found:
        filled[r["shard"]] += r["size"]
    assert max(filled.values()) == cuts.capacity and set(filled) == set(range(8))
    assert len({(r["key"], r["shard"]) for r in found}) == len(groups)
    assert [r["shard"] for r in sorted(found, key=lambda r: r["key"])] == sorted(r["shard"] for r in found)


def test_sharding_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r.asDict() for r in sharding.op11_sharding(spark, SF).collect()]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    keyed = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in groups], "t string").withColumn("k", sharding.text_key(sharding.F.col("t"))).collect()}
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) == smallest_capacity([groups[t] for t in sorted(groups, key=keyed.get)], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_sharding_edges(spark, tmp_path):
    schema = "doc_id long, text string, shard string, row int, key int"
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "x", 1, 1), (None, "", "x", 1, 1), (2, "a", "x", 1, 1), (2, "a", "x", 1, 1), (3, "é" * 50_000, "x", 2, 3), *[(k, "copy", None, None, None) for k in range(40)]]
    docs = spark.createDataFrame(rows, schema)
    found = sharding.shard_documents(docs, 3)
    assert found.columns == ["doc_id", "text", "row", "key", "shard", "slot"] and found.count() == len(rows)
    where = {}
    for r in found.collect():
        assert where.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r["shard"] for r in back.collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        sharding.minimax(docs.selectExpr("doc_id key", "doc_id size"), 0)


def edits(word, letters):
    """All strings at one inserted, deleted or replaced letter from ``word``."""
    halves = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    inserted = {a + c + b for a, b in halves for c in letters}
    changed = {a + c + b[1:] for a, b in halves if b for c in letters}
    return (inserted | changed | {a + b[1:] for a, b in halves if b}) - {word}


def brute_variants(docs, thin=97, least=5, often=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if thin and h % thin == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= often and len(w) >= least}
    out, letters = {}, {c for w in words for c in w}
    for w, n in words.items():
        others = [v for v in edits(w, letters) if v in words]
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= 2 * n else None
        out[w] = [form, n, len(others), words.get(form)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = as_dict(spelling.op12_spelling(spark, SF))
    want = brute_variants(docs)
    assert found == want and sum(v[0] is not None for v in want.values()) > 20


@pytest.mark.parametrize("seed", range(3))
def test_spelling_of_few_letters(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(spelling, "LONG", 6)  # both ways of verifying, and their border
    pool = ["".join(rng.choice("abéC×") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    docs = [(rng.choice([None, k]), rng.choice([" ", "\n", "1", "œ"]).join(rng.choices(pool, k=rng.randint(0, 40)))) for k in range(60)] + [(7, None), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for thin in (None, 3):
        assert as_dict(spelling.variants(df, thin=thin)) == brute_variants(docs, thin)


def test_spelling_edges(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "b" * 9_000
    rows = [(k, f"{long} {long[1:]} x{long[1:]} hello Hello hallo hellos HELLO hello") for k in range(3)]
    found = as_dict(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == {long: [None, 3, 2, None, long], long[1:]: [None, 3, 2, None, long[1:]], "x" + long[1:]: [None, 3, 2, None, "x" + long[1:]], "hello": [None, 12, 2, None, "hello"], "hallo": ["hello", 3, 1, 12, "hello"], "hellos": ["hello", 3, 1, 12, "hello"]}
    docs = spark.createDataFrame([(1, "Hallo, hellos! Über", "k"), (2, None, "k"), (1, "Hallo, hellos! Über", "k")], "doc_id long, text string, h string")
    roots = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, spelling.respelled(docs, roots).collect()), key=str) == [(1, "hello, hello! Über", "k")] * 2 + [(2, None, "k")]


def test_deletion_keys():
    words = ["abcde", "aab", "ééé", "z" * 300]
    own, without, first = spelling.deletion_keys(words)
    at = 0
    for k, w in enumerate(words):
        rests = [w[:i] + w[i + 1 :] for i in range(len(w))]
        assert without[at : at + len(w)].tolist() == spelling.deletion_keys(rests)[0].tolist()
        assert first[at : at + len(w)].tolist() == [i == 0 or w[i] != w[i - 1] for i in range(len(w))]
        at += len(w)
    assert len(set(own.tolist())) == len(words)


def test_hash_collisions_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "run_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert spelling.counted_batch(["1", "2"], pa.array(["abcde abcde abcdef", "fghij abcde"]), 5, None) == {b"abcde": 3, b"abcdef": 1, b"fghij": 1}
    out = []
    spelling._told(["abcdx", "abcdy", "qqqqq"], [4, 4, 4], [True] * 3, [5, 3, 9], out)
    assert sorted(out) == [("abcdx", 1, 3, "abcdy"), ("abcdy", 1, 5, "abcdx")]


def brute_whitening(rows):
    good = [(i, [int(np.floor(64.0 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    n, dims = len(good), len(good[0][1])
    total = [sum(x[a] for _, x in good) for a in range(dims)]
    d = [[n * x[a] - total[a] for a in range(dims)] for _, x in good]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in d), n**3)) for b in range(dims)] for a in range(dims)])
    return good, n, d, v


def check_whitening(rows, found, exact):
    good, n, d, v = exact
    kept = max(r["component"] for r in found)
    assert len(found) == len(good) * kept and {r["n"] for r in found} == {n}
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    place = {i: k for k, (i, _) in enumerate(good)}
    w = np.zeros((len(good), kept))
    for r in found:
        k = place[r["vec_id"]]
        assert r["deviation"] == sum(c * c for c in d[k])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-4)
        w[k, r["component"] - 1] = r["whitened"]
    want = (np.array(d, dtype=float) / n) @ vectors[:, :kept] / np.sqrt(values[:kept])
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, atol=1e-6)
    error = np.abs(w.T @ w / n - np.eye(kept)).max()
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] == pytest.approx(error, abs=1e-9) and error < 1e-4


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = [r.asDict() for r in whitening.op13_whitening(spark, SF).collect()]
    assert max(r["component"] for r in found) == 32
    check_whitening(rows, found, brute_whitening(rows))


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=4) * [1, 2, 3, 0]]) for k in range(300)]  # the last dimension is constant
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf")] * 4), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 4)]
    schema = "id long, vector array<double>, component string, n string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + bad], schema)
    found = [r.asDict() | {"vec_id": r["id"]} for r in whitening.components(whitening.as_vectors(df, "id", "vector")).collect()]
    assert max(r["component"] for r in found) == 3
    check_whitening(rows, found, brute_whitening(rows))
    far = [(k, [float(c) for c in rng.normal(size=3) * [1e15, 1, 1]]) for k in range(50)]  # products far beyond a long
    got = whitening.fit(spark.createDataFrame(far, "id long, vector array<double>"))
    assert np.allclose(got.values[0], np.linalg.eigvalsh(brute_whitening(far)[3])[-1], rtol=1e-12)
    assert all(r["deviation"] is None for r in whitening.whitened(spark.createDataFrame(far, "id long, vector array<double>"), got).limit(5).collect())
    for few in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.components(spark.createDataFrame(few, "id long, vector array<double>")).count() == 0


def test_digit_slices_are_exact():
    rng = np.random.default_rng(5)
    d = rng.integers(-(1 << 60), 1 << 60, size=(500, 3))
    limbs = 4
    parts = whitening.products(d, limbs)
    big = d.astype(object)
    want = big.T @ big
    got = sum(parts[k].astype(object) << (16 * k) for k in range(len(parts)))
    assert (got == want).all()
