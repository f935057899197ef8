"""The ten operators against brute force, held-out accuracy and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, graph, langid, lm, mixing, paragraphs, quality, ranges, registry, simhash, toxicity, urls
from tidemark.llm.common import remainder, shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size string"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, schema: str = SCHEMA, sources=("a", "b", None)):
    """Documents with two extra columns whose names clash with those of operators."""
    rows = [(i, t, "en" if i % 2 else "de", sources[i % len(sources)], None if t is None else len(t), 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " \n\t ", "one", "two words", "ß É ñ 漢字 \x00", "a" * 5000, "word " * 30_000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables with nulls, copies, near copies, passages, leaks and labels."""
    rng = random.Random(11)
    passage = prose(60, rng)
    near = passage.split()
    near[30] = "changed"
    items = [prose(n, rng) for n in (8, 14, 30, 50)] + ["tiny item"]
    texts = list(ODD)
    for i in range(160):
        lines = [prose(rng.randint(5, 35), rng) for _ in range(rng.randint(1, 5))]
        if i % 8 == 0:
            lines.insert(1, passage if i % 16 else " ".join(near))
        if i % 10 == 3:
            lines[0] += " " + items[i % 4] + " " + prose(5, rng)
        if i % 4 == 1:
            lines[0] = lines[0].upper() + " !!! " * 9
        if i % 5 == 2:
            lines[-1] += " horrid vile" + " nasty" * (i % 3)
        texts.append("\n".join(lines))
    texts += texts[20:26] + [texts[30] + " tail"]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = table(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 40")).unionByName(spark.createDataFrame([(None, "no id " + prose(30), None, None, None, 1, "y")], SCHEMA))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("!!!" not in (t or "")), int("vile" in (t or ""))) for i, t in enumerate(texts) if i % 10 != 9] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(0, None), (1, "no scheme"), (2, "HTTP://Blog.Example.ORG/es/x?q#f"), (3, "https://example.org/en/17"), (4, "https://example.org/en/27"), (5, "http://x.com/de/1"), (6, "http://casino-bonus.net/promo/win-now"), (7, "http://org/"), (8, "http://org"), (9, "http://notorg/")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return path


def read(spark, folder, name="documents"):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark", "pages"):
        read(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- simhash ----------------------------------------------------------------------------------------


def slow_fingerprint(text: str | None) -> int:
    import xxhash

    low = (text or "").encode().lower().split()
    grams = [b" ".join(low[i : i + 3]) for i in range(max(len(low) - 2, 1))] if low else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_against_brute_force(spark, folder):
    got = simhash.op2_simhash(spark, folder).collect()
    docs = read(spark, folder).collect()
    assert len(got) == len(docs)
    prints = {(r.doc_id, slow_fingerprint(r.text)) for r in docs}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == prints
    values = sorted({p for _, p in prints})
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    smallest = {}
    for i, v in prints:
        if i is not None:
            smallest[find(v)] = min(i, smallest.get(find(v), i))
    assert all(r.component_id == smallest.get(find(int(r.fingerprint, 16))) for r in got)


def test_covering_masks_leave_no_pair_out():
    masks = simhash.covering_masks(3)
    rng = random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        change = sum(1 << p for p in rng.sample(range(64), 3))
        assert any(not change & m for m in masks)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_a_dense_ball(spark, block):
    """A large group of near fingerprints, with cells of many blocks and of one."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre} | {centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r.id: r.root for r in graph.components(simhash.near_links(df, 3, block)).collect()}
    ordered = sorted(simhash.signed(v) for v in values)
    label = {v: v for v in ordered}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert all(roots.get(v, v) == label[v] for v in ordered)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.id: r.root for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_keep_one(spark, folder):
    docs = read(spark, folder)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    best = {r.component_id for r in simhash.op2_simhash(spark, folder).collect()}
    assert sorted(ids, key=str) == sorted(best, key=str)


# ---- passages ---------------------------------------------------------------------------------------


def slow_paragraphs(texts: dict[int, list[str]]):
    """(words that stay, words that go) as (document, place), of all equal paragraphs of 50 words."""
    where = defaultdict(set)
    for d, w in texts.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add((d, k))
    stays, goes = set(), set()
    for places in where.values():
        least = min(d for d, _ in places)
        if any(d != least for d, _ in places):
            for d, k in places:
                (stays if d == least else goes).update((d, i) for i in range(k, k + 50))
    return stays, goes


def slow_near_words(texts: dict[int, list[str]]):
    """Words (document, place) of all pairs of paragraphs of different documents at Jaccard 0.8, from the first to the last common shingle."""
    once = {(d, tuple(w[k : k + 50])): k for d, w in texts.items() for k in range(len(w) - 50, -1, -1)}
    grams = {(d, k): [w[i : i + 5] for i in range(46)] for (d, w), k in once.items()}
    sets, holders = {p: set(g) for p, g in grams.items()}, defaultdict(list)
    for p, own in sets.items():
        for g in own:
            holders[g].append(p)
    out = set()
    for p, own in sets.items():
        for q, n in Counter(q for g in own for q in holders[g] if q[0] != p[0]).items():
            if n >= 0.8 * (len(own) + len(sets[q]) - n):
                common = [i for i, g in enumerate(grams[p]) if g in sets[q]]
                out.update((p[0], p[1] + i) for i in range(common[0], common[-1] + 5))
    return out


def found_words(rows):
    got = {True: set(), False: set()}
    for r in rows:
        assert r.kept == (r.keeper == r.doc_id) and r.stop - r["first"] >= 45
        got[r.kept].update((r.doc_id, k) for k in range(r["first"], r["stop"]))
    return got[True], got[False]


def test_passages_against_brute_force(spark, folder):
    """Every word of equal paragraphs is found, nothing but equal and near ones, and nearly all of those."""
    docs = read(spark, folder)
    texts = {r.doc_id: (r.text or "").lower().split() for r in docs.collect() if r.doc_id is not None}
    stays, goes = found_words(paragraphs.passages(docs).collect())
    equal, near = slow_paragraphs(texts), slow_near_words(texts)
    assert equal[0] | equal[1] <= stays | goes <= near and len({d for d, _ in goes}) > 10
    assert len(stays | goes) >= 0.9 * len(near)
    changed = {d for d, _ in goes}
    after = {(r.doc_id, r.text, r.n_chars) for r in paragraphs.dedup(docs).collect()}
    for r in docs.collect():
        if r.doc_id not in changed:
            assert (r.doc_id, r.text, r.n_chars) in after
    left = {d: n for d, t, n in after if d in changed}
    assert all(n == (None if t is None else len(t)) for d, t, n in after if d in changed)
    assert all(len([1 for i in range(len(texts[d])) if (d, i) not in goes]) <= n + 1 for d, n in left.items())


def test_a_passage_inside_longer_lines(spark):
    passage = ". ".join(prose(17, random.Random(9)).capitalize() for _ in range(4)) + "."
    texts = ["Alone.\n" + passage, "First words. " + passage + " Last words here.", prose(70, random.Random(10)) + "."]
    docs = table(spark, texts)
    got = {r.doc_id: r.text for r in paragraphs.dedup(docs).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[1] == "First words. Last words here."


def test_runs_over_lines_and_without_stops(spark):
    """Equal stretches of 50 words or more to the word: over line breaks, in short lines, mid-sentence, with other stops."""
    rng = random.Random(31)
    a, b, c, d = (prose(n, rng).split() for n in (54, 50, 44, 130))
    wrapped = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    texts = [
        prose(20, rng) + "\n" + wrapped(a, 20) + "\n\n" + prose(5, rng),
        wrapped(a, 7) + " and " + prose(30, rng),
        prose(33, rng) + ", " + " ".join(b) + " " + prose(9, rng),
        "x! " + prose(3, rng) + "\n" + " ".join(b).upper() + " ? " + prose(12, rng),
        " ".join(c) + " one " + prose(9, rng),
        "two " + " ".join(c) + " three " + " ".join(d),
        prose(60, rng) + " " + " ".join(d[:100]) + "\n" + " ".join(d[40:]),
        None,
    ]
    docs = table(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 1"))
    stays, goes = found_words(paragraphs.passages(docs).collect())
    assert (stays, goes) == slow_paragraphs({i: (t or "").lower().split() for i, t in enumerate(texts)})
    assert {i for i, _ in goes} == {1, 3, 6}
    after = {r.doc_id: r.text for r in paragraphs.dedup(docs).collect()}
    assert after[0] == texts[0] and after[2] == texts[2] and after[1].startswith("and ") and " ".join(b).upper()[:20] not in after[3]


def test_edited_passages_inside_longer_lines(spark):
    """A word in the middle of a shared passage is changed, or one left out; the passage stands in mid-line in both documents."""
    rng = random.Random(77)
    texts, lengths = [], []
    for words in (55, 60, 75, 90):
        for k in range(100):
            p = prose(words, rng).split()
            q = list(p)
            q[words // 2 : words // 2 + 1] = [] if k % 4 == 0 and words > 60 else ["otherwise"]
            texts += [f"{prose(12, rng)} {' '.join(p)} {prose(15, rng)}", f"{prose(25, rng)} {' '.join(q)} {prose(8, rng)}"]
            lengths += [0, len(q)]
    stays, goes = found_words(paragraphs.passages(table(spark, texts)).collect())
    assert {d % 2 for d, _ in goes} == {1}
    for i in range(4):
        of = range(200 * i, 200 * (i + 1))
        assert sum(d in of for d, _ in goes) >= 0.9 * sum(lengths[d] for d in of), i


def test_two_edits(spark):
    """Two changed words, of which no paragraph of the middle holds both."""
    rng = random.Random(78)
    texts, size = [], 0
    for _ in range(60):
        p = prose(120, rng).split()
        q = [("otherwise" if i in (30, 90) else w) for i, w in enumerate(p)]
        texts += [f"{prose(12, rng)} {' '.join(p)} {prose(15, rng)}", f"{prose(25, rng)} {' '.join(q)} {prose(8, rng)}"]
        size += len(q)
    goes = found_words(paragraphs.passages(table(spark, texts)).collect())[1]
    assert {d % 2 for d, _ in goes} == {1} and len(goes) >= 0.9 * size


def test_texts_of_one_id_keep_their_places(spark):
    p = prose(60, random.Random(41))
    docs = spark.createDataFrame([(1, "a " + p), (2, p + " b"), (2, "c d e " + p), (2, "f " * 70), (None, p)], "doc_id long, text string")
    after = sorted(str(r.text) for r in paragraphs.dedup(docs).collect())
    assert after == sorted(["a " + p, "b", "c d e ", "f " * 70, p])


def test_clashing_columns(spark):
    p = prose(60, random.Random(42))
    rows = [(i, p, i, i, i, i, i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag long, c0 long, first long, gone_id long, `_0` long")
    after = paragraphs.dedup(docs)
    assert after.columns == docs.columns and {(r.doc_id, r.text == p, r.tag, r["_0"]) for r in after.collect()} == {(0, True, 0, 0), (1, False, 1, 1), (2, False, 2, 2)}


def test_hashed_words():
    import pyarrow as pa

    rng = random.Random(8)
    texts = [None, "", " a  B\tc\n", "A b", "x" * 200_000 + " y", "\x0b \x0c", "é É ß", *[" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 900))) for _ in range(300)]]
    for column in (pa.array(texts), pa.chunked_array([pa.array(["skipped", *texts])]).chunk(0).slice(1)):
        hashes, firsts = paragraphs.hashed_words(column)
        words = [(t or "").encode().lower().split() for t in texts]
        assert np.diff(firsts).tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_values_are_the_least_of_every_paragraph(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(paragraphs, "STEP", 64)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 49, 50, 51, 200, 300)]
    words, firsts = paragraphs.hashed_words(pa.array(texts))
    got = []
    for part in paragraphs.parts(words, firsts):
        _, least, new = part.value(1)
        sizes = np.diff(np.append(new, len(least)))
        got += list(zip(part.row.tolist(), (part.start + part.at - firsts[part.row]).tolist(), np.repeat(least[new], sizes).tolist(), strict=True))
    expected = []
    for row, (a, b) in enumerate(zip(firsts, firsts[1:], strict=False)):
        own = (paragraphs.shingle_values(words[a:b]) ^ paragraphs._DRAW[1, 0]) * paragraphs._DRAW[1, 1]
        expected += [(row, k, int(own[k : k + 46].min())) for k in range(b - a - 49)]
    assert got == expected and len(got) == 1 + 2 + 151 + 251


def test_cut():
    text = b"a b c d\n e f \ng"
    assert paragraphs.cut(text, [{"first": 1, "stop": 3}, {"first": 2, "stop": 3}, {"first": 4, "stop": 6}]) == b"a d\n g"
    assert paragraphs.cut(text, [{"first": 0, "stop": 99}]) == b"" and paragraphs.cut(text, []) == text


def test_tuning_reaches_the_recall():
    rng = np.random.default_rng(2)
    for similarity in (0.5, 0.8, 0.95):
        agree = rng.random((200_000, paragraphs.VALUES)) < similarity
        assert abs((agree & np.roll(agree, 1, axis=1)).any(axis=1).mean() - paragraphs.collide(similarity, paragraphs.VALUES)) < 0.005
    assert paragraphs.collide(0.8, paragraphs.VALUES) >= paragraphs.RECALL and paragraphs.collide(1.0, paragraphs.VALUES) == 1
    with pytest.raises(ValueError):
        paragraphs.tune(0.01)


@pytest.mark.parametrize("block", [2, 1024])
def test_a_large_group_of_near_passages(spark, block):
    base = prose(80, random.Random(5)).split()
    texts = []
    for i in range(40):
        w = list(base)
        w[i] = f"edit{i}"
        texts.append(" ".join(w))
    got = paragraphs.passages(table(spark, texts), block=block).collect()
    assert {r.doc_id for r in got} == set(range(40)) and {r.keeper for r in got if r["stop"] == 80} == {0}
    assert len(found_words(got)[1]) >= 0.9 * 39 * 79


# ---- benchmark --------------------------------------------------------------------------------------


def test_containment_against_brute_force(spark, folder, monkeypatch):
    docs, items = read(spark, folder), read(spark, folder, "benchmark")
    expected = set()
    for r in docs.distinct().collect():
        words = (r.text or "").lower().split()
        for item in items.collect():
            own = (item.text or "").lower().split()
            size = min(5, len(own))
            if size:
                want, have = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (own, words)]
                if len(want & have) >= 0.8 * len(want):
                    expected.add((r.doc_id, item.item_id, len(want & have)))
    got = {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.contained(docs, items).collect()}
    assert got == expected and len(expected) >= 10
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)  # several passes
    assert {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.contained(docs, items).collect()} == expected
    left = {r.doc_id for r in decontaminate.clean(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _, _ in expected}


# ---- fingerprints -----------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_of_a_range", [1, 7, 1000])
def test_edited_texts(spark, folder, rows_of_a_range):
    docs = read(spark, folder).dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs, rows_of_a_range).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    assert len(got) == len(rows)
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
        assert got[i].near_next == 1 - (int(got[i].fingerprint, 16) ^ int(got[j].fingerprint, 16)).bit_count() / 64
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_votes(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, ""), (3, "alpha")], "k int, t string")
    got = {r.k: r.fp for r in fingerprints.voted(df, ["k"], "t").collect()}
    terms = spark.sql("SELECT xxhash64('alpha', 'beta') a, xxhash64('beta', 'gamma') b, xxhash64('gamma', '') c, xxhash64('alpha', '') d").first()
    votes = [(terms.a, 5), (terms.b, 4), (terms.c, 5)]
    expected = sum(1 << k for k in range(64) if 2 * sum(w for h, w in votes if h >> k & 1) > 14)
    assert got[1] & (2**64 - 1) == expected and got[2] == 0 and got[3] == terms.d


def test_block_tables_find_every_pair(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted(set(base) | {b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(3)})
    got = {tuple(sorted((r.a & (2**64 - 1), r.b & (2**64 - 1)))) for r in fingerprints.within_radius(spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long"), 3, 8).collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_range_buckets(spark):
    cuts = [3, 5, 9, 14, 20, 21, 40]
    df = spark.range(50)
    got = [r.b for r in df.select("id", ranges.bucket(F.col("id"), cuts).alias("b")).orderBy("id").collect()]
    assert got == [sum(c < i for c in cuts) for i in range(50)]


# ---- urls -------------------------------------------------------------------------------------------


def test_urls(spark, folder):
    got = {r.page_id: r for r in urls.op6_url_filter(spark, folder).collect()}
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[1].host == ""
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("blog.example.org", "/es/x", "example.org/es/", "block")
    assert (got[3].rule, got[4].rule, got[5].rule) == ("example.org/en/1", "org/", "com/de/")
    assert got[6].rule is None and got[6].verdict == "block"
    assert (got[7].rule, got[8].rule, got[9].rule) == ("org/", None, None)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    assert sorted(con.execute(urls.op6_sql()).fetchall()) == sorted(tuple(r) for r in got.values())


def test_url_model_learns_its_table(spark):
    rows = urls.labelled_urls()
    df = spark.createDataFrame([(f"http://{h}{p}", y) for h, p, y in rows], "url string, host long")
    judged = urls.judge(df.select("url"), rules=())
    got = {r.url: r.verdict for r in judged.collect()}
    assert np.mean([(got[f"http://{h}{p}"] == "block") == bool(y) for h, p, y in rows]) > 0.97


# ---- models -----------------------------------------------------------------------------------------


def test_segments_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        tokens = [rng.choice([0, 0, 1.5, 0.5, 3.0]) for _ in range(rng.randint(1, 14))]
        gap = 0.75  # sums are exact, so ties are ties
        scores = [t if t else -gap for t in tokens]
        hits = [(i, t) for i, t in enumerate(tokens) if t]
        found = toxicity.segments(hits, gap)

        def best(a, b):
            """The best segment within [a, b), and within what is left on both sides."""
            top = max(((sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0), key=lambda x: (round(x[0], 9), x[1], -x[2]))
            if top[0] <= 0:
                return []
            return best(a, top[2]) + [(top[2], top[3] - 1, top[0])] + best(top[3], b)

        expected = best(0, len(scores))
        assert sum(s for _, _, s in found) == pytest.approx(sum(s for _, _, s in expected))
        assert max((s for _, _, s in found), default=0) == pytest.approx(max((s for _, _, s in expected), default=0))


def test_segments_one_by_one_and_in_linear_time():
    """The segments themselves, by the definition: the best one, then the same on either side of it."""
    import time

    rng = random.Random(16)
    for _ in range(200):
        scores = [rng.choice([-0.75, -0.75, rng.random() * 3]) for _ in range(rng.randint(1, 16))]

        def best(a, b):
            top = max(((sum(scores[i:j]), j - i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return best(a, top[2]) + [(top[2], top[3] - 1)] + best(top[3], b) if top[0] > 1e-12 else []

        found = toxicity.segments([(i, x) for i, x in enumerate(scores) if x > 0], 0.75)
        assert [(a, b) for a, b, _ in found] == best(0, len(scores))
        assert all(x == pytest.approx(sum(scores[a : b + 1])) for a, b, x in found)
    for step in (1, 3, 40):  # dense, balanced and sparse hits
        began = time.time()
        toxicity.segments([(i * step, 1.0 + rng.random()) for i in range(200_000)], 0.75)
        assert time.time() - began < 10


def auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(s, y, strict=True) if i for b, j in zip(s, y, strict=True) if not j]
    return float(np.mean(pairs))


def test_toxicity(spark, folder):
    got = toxicity.op7_toxicity(spark, folder).collect()
    docs = read(spark, folder)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert auc(["vile" in texts[r.doc_id] for r in held], [r.score for r in held]) > 0.9
    model = toxicity.fit(docs, toxicity.training_labels(spark, folder))
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if not r.predicted)


def test_quality(spark, folder):
    got = quality.op1_quality(spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in read(spark, folder).collect()}
    assert len(got) == read(spark, folder).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert auc(["!!!" not in texts[r.doc_id] for r in held], [r.score for r in held]) > 0.9


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    s = rng.normal(size=500)
    x, p = quality.isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(x) > 0).all() and 0 <= p[0] <= p[-1] <= 1


def test_normal_equations(spark):
    x = np.random.default_rng(2).normal(size=(50, len(quality.NAMES)))
    fourier = quality.Fourier(x.mean(0), x.std(0), size=8)
    df = spark.createDataFrame([(r.tolist(), float(i % 2)) for i, r in enumerate(x)], "x array<double>, label double").repartition(3)
    a, b = quality.normal_equations(df, fourier)
    z = fourier(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ (np.arange(50) % 2))


def test_language(spark):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "der", "ein", "ö"], "fr": ["eau", "que", "é", "les", "oux"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang) for i in range(240) for lang in [list(parts)[i % 3]]]
    rows += [(900, None, "en"), (901, "12 34", "de"), (902, "", None), (None, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter((remainder(4) != 2) & (remainder(4) >= 0)))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == "und" for i in (900, 901, 902))
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_lm_scores(spark, folder):
    got = lm.op9_lm_scoring(spark, folder)
    rows = got.collect()
    docs = read(spark, folder).collect()
    train = [r for r in docs if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in (r.text or "").encode().lower().split())
    counts[None] = len(train)
    total, kinds = sum(counts.values()), len(counts)
    expected = Counter()
    for r in docs:
        tokens = [*(r.text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        expected[(r.doc_id, len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == expected
    assert all(r.train_tokens == total and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert np.mean([r.score > r.base_score for r in held]) > 0.5


def test_small_head_gives_the_same_base(spark, folder):
    docs = read(spark, folder).select("doc_id", "text").limit(60)
    a, b = (sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm.score(docs, docs, depth=2, head=h).collect()) for h in (5, 100_000))
    assert a == b


def test_tree_is_a_distribution():
    texts = [prose(200).encode() for _ in range(20)]
    codes = lm.stream(texts, 3)[0]
    unique, n = np.unique(codes, return_counts=True)
    grams = []
    for d in range(4):
        k, at = np.unique(lm.context(unique, d), return_inverse=True)
        grams.append((k, np.bincount(at, weights=n).astype(np.int64)))
    tree = lm.build_tree(grams)
    for context in (codes[5], codes[99], np.uint64(0x7A7A7A00)):
        every = (context & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.predict(every)).sum() == pytest.approx(1, abs=1e-5)
    seen = lm.Seen(unique, tree.predict(unique))
    assert np.allclose(lm.log_probabilities(codes, seen, tree), tree.predict(codes))


def slow_ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """log10 of the probability of ``text`` by context-tree weighting that keeps every context, node by node."""
    pieces = lambda t: bytes([lm.END]) * depth + b" ".join(t.lower().split()) + bytes([lm.END])
    counts = defaultdict(lambda: [0, 0])
    for t in map(pieces, train):
        for i in range(depth, len(t)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[t[i - d : i], (t[i] | 256) >> (8 - bit)][t[i] >> (7 - bit) & 1] += 1
    children = defaultdict(list)
    for context, prefix in counts:
        if context:
            children[context[1:], prefix].append((context, prefix))
    estimate = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    own, mixed = {}, {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        below = sum(mixed[c] for c in children[k])
        mixed[k] = estimate[k] if len(k[0]) == depth else float(np.logaddexp(estimate[k], below)) - math.log(2)
        own[k] = 1.0 if len(k[0]) == depth else math.exp(estimate[k] - math.log(2) - mixed[k])
    total, t = 0.0, pieces(text)
    for i in range(depth, len(t)):
        for bit in range(8):
            p, fresh = 0.5, True
            for d in range(depth, -1, -1):
                k = (t[i - d : i], (t[i] | 256) >> (8 - bit))
                if k in counts:
                    a, b = counts[k]
                    w, fresh = 1.0 if fresh else own[k], False
                    p = w * ((b if t[i] >> (7 - bit) & 1 else a) + 0.5) / (a + b + 1) + (1 - w) * p
            total += math.log10(p)
    return total


@pytest.mark.parametrize(("depth", "head_grams", "chunk"), [(5, 1_000_000, 200_000), (5, 100, 300), (1, 0, 50)])
def test_every_context_counts(spark, depth, head_grams, chunk):
    rng = random.Random(21)
    texts = [prose(40, rng) + " été 漢字" for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[3], "zzz unseen QQ " + texts[0][:50], None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, docs.filter("doc_id < 12"), depth, head_grams=head_grams, chunk=chunk).collect()}
    train = [t.encode() for t in texts]
    for i, t in rows:
        assert got[i] == pytest.approx(slow_ctw(train, (t or "").encode(), depth), abs=1e-6)


def test_contexts_beyond_the_old_cap_count(spark):
    """More than 80 000 contexts of depth 5, each met once: all of them are known to the model."""
    rng = random.Random(22)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(80)) for _ in range(160)]
    codes = lm.stream([t.encode() for t in texts], 5)[0]
    assert len(np.unique(codes >> np.uint64(8))) > 80_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = lm.subtrees(*np.unique(codes, return_counts=True), 0, 5)
    got = {r.doc_id: r.score for r in lm.score(docs, docs, head_grams=50_000).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(tree.predict(lm.stream([t.encode()], 5)[0]).sum(), rel=1e-9)


# ---- mixing -----------------------------------------------------------------------------------------


def test_mixing(spark, folder):
    rows = mixing.op10_mixing(spark, folder).collect()
    docs = read(spark, folder).collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    targets, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weights[s] / sum(weights[t] for t in order if t not in capped) for s in order if s not in capped}
        above = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not above:
            targets = share | {s: 3 * sizes[s] for s in capped}
            break
        capped |= above
    by_id = {r.doc_id: r.source for r in docs}
    taken = Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and r.target == pytest.approx(targets[by_id[r.doc_id]])
        taken[by_id[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op10_mixing(spark, folder).collect()))


def test_capped_targets(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 20), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, [1, 2, 3]).collect()}
    assert got["b"] == 30 and got["c"] == 60 and got["a"] == 940 and got[None] == 0


def test_curriculum(spark):
    df = spark.range(1).select(mixing.inverse_demand(F.lit(0.25), F.lit(0.0), F.lit(2.0)).alias("up"), mixing.inverse_demand(F.lit(0.25), F.lit(1.0), F.lit(1.0)).alias("flat")).first()
    assert df.up == pytest.approx(0.5) and df.flat == 0.25


def test_every_pass_has_a_position(spark):
    """A source taken two and a half times under a rising weight, held against numeric integration."""
    docs = spark.createDataFrame([(i, "a", 10) for i in range(20)] + [(100, "b", 5000), (101, "b", 0)], "doc_id long, source string, size long")
    schedules = spark.createDataFrame([("a", 1.0, 3.0)], "source string, start double, end double")
    rows = mixing.mix(docs, [1, 10], 3, schedules).collect()
    grid = np.linspace(0, 1, 200_001)
    demand = np.cumsum(1 + 2 * grid) / np.sum(1 + 2 * grid)
    a = [r for r in rows if r.source == "a"]
    goal = round(a[0].target)
    assert 2 * 200 < goal < 3 * 200 and sum(r.taken for r in a) == goal
    laid = sorted((x, r.size) for r in a for x in r.positions)
    expected = [float(grid[np.searchsorted(demand, k * 10 / goal)]) for k in range(len(laid))]
    assert [x for x, _ in laid] == pytest.approx(expected, abs=1e-4)
    assert all(len(r.positions) == math.ceil(r.taken / r.size) if r.size else r.positions == [] for r in rows)


# ---- all --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables(spark, folder, tmp_path, name):
    assert registry.queries()[name](spark, empty(spark, folder, tmp_path)).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = read(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    last = corpus_pipeline.run(spark, folder)
    assert last.count() == docs.count() and {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_shingle_hashes_follow_order():
    h = word_hashes([b"a", b"b", b"c"], {})
    assert len(shingle_hashes(h, 5)) == 1 and shingle_hashes(h, 2)[0] != shingle_hashes(h[::-1].copy(), 2)[1]
