"""Stored structures: band index, versioned tables."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.operators import bandindex, dedup, skillmatch, tree
from tidemark.sources import files


def texts(n, seed=1, words=120):
    """``n`` texts, every third one an edited copy of the one before."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 == 2:
            parts = out[-1].split(" ")
            parts[rng.randrange(len(parts))] = "edited"
            out.append(" ".join(parts))
        else:
            out.append(" ".join(rng.choice("abcdefghij") + str(rng.randrange(4000)) for _ in range(words)))
    return out


def signed(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").select("id", F.col("id").alias("ord"), dedup.signature("text").alias("sig"))


def partitions_read(df):
    """How many partitions of a table the scan of ``df`` opened."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numPartitions").value()


def test_band_index(spark):
    found = texts(300)
    rows = [*enumerate(found), (300, found[7]), (301, found[7]), (302, ""), (303, None)]
    old, new = [r for r in rows if r[0] < 280], [r for r in rows if r[0] >= 280]
    index = bandindex.BandIndex.create(signed(spark, old), tables.fresh(spark, "t"), buckets=256)
    # a small batch reads few of the buckets
    one = signed(spark, new[:1])
    banded = index._banded(index._classed(one).select("class", "sig"))
    stored = index._stored("bands", index._hit(banded, "bucket"))
    assert 0 < partitions_read(stored) < 0.2 * partitions_read(index._stored("bands", None))
    index.add(signed(spark, new))
    got = {r["id"]: r["duplicate_of"] for r in index.rescan(signed(spark, new)).collect()}
    # the batch operator over all records gives the same verdicts
    want = {r["id"]: r["duplicate_of"] for r in dedup.greedy(dedup.near_pairs(signed(spark, rows), bands=32)).collect() if r["id"] >= 280}
    assert got == want and got[300] == 7 and got[301] == 7 and 302 not in got and len(got) > 6
    again = index.compact()
    again.add(signed(spark, new))  # a repeated append changes no verdict
    assert {r["id"]: r["duplicate_of"] for r in again.rescan(signed(spark, new)).collect()} == want
    with pytest.raises(ValueError):
        bandindex.BandIndex.create(signed(spark, old), tables.fresh(spark, "t"), bands=7)


def test_rescan_of_jobs(spark):
    base = datetime(2024, 5, 1)
    rows = [(k, base + timedelta(hours=k), "active", None, "c", "h", t) for k, t in enumerate(texts(30, 4))]
    jobs = spark.createDataFrame(rows, "id long, first_seen_at timestamp, status string, duplicate_of long, company_name string, content_hash string, text string").withColumn("signature", dedup.signature("text"))
    index = bandindex.BandIndex.create(jobs.select("id", F.col("first_seen_at").alias("ord"), F.col("signature").alias("sig")), tables.fresh(spark, "t"), buckets=64)
    verdicts, marked = bandindex.rescan_jobs(jobs, index, base + timedelta(hours=20))
    want = {k: k - 1 for k in range(20, 30) if k % 3 == 2}
    assert {r["id"]: r["duplicate_of"] for r in verdicts.collect()} == want
    assert {r["id"]: r["duplicate_of"] for r in marked.filter("duplicate_of is not null").collect()} == want and marked.count() == 30


def test_keyed_table(spark):
    schema = spark.createDataFrame([], "k long, t long, v string").schema
    table = tables.KeyedTable.create(spark, tables.fresh(spark, "t"), schema, ["k"], 4)
    put = tables.upserting(table, "t", "w")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    put(frame([(1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (None, 1, "n")]), 0)
    put(frame([(1, 3, "c"), (3, 1, "d")]), 1)
    before = table.state()
    put(frame([(1, 9, "replayed"), (9, 9, "replayed")]), 1)  # known by its number
    assert table.state() == before
    put(frame([(1, 2, "late"), (3, 1, "tie"), (None, 2, "m")]), 2)
    assert sorted(map(tuple, table.read().collect()), key=str) == [(1, 3, "c"), (2, 2, "b"), (3, 1, "tie"), (None, 2, "m")]
    assert sorted(map(tuple, table.read(version=1).collect()), key=str) == [(1, 1, "a"), (2, 2, "b"), (None, 1, "n")]
    # a merge that dies before its log file is no version, and repeating it is right
    state = table.state()
    with pytest.raises(RuntimeError):
        table.merge(frame([(5, 1, "x")]), 3, lambda old, new: (_ for _ in ()).throw(RuntimeError("lost")), "w")
    assert table.state() == state
    put(frame([(5, 1, "x")]), 3)
    put(frame([]), 4)
    with pytest.raises(FileExistsError):  # two writers of one version
        tables.put_json(spark, f"{table.folder}/_log/{table.versions()[-1]:012d}.json", {})
    table.vacuum(1)
    assert table.versions() == [5] and {r["k"] for r in table.read().collect()} == {1, 2, 3, 5, None}


def test_shared_folder(spark):
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_tree(spark):
    frame = lambda rows: spark.createDataFrame(rows, "child string, parent string")
    edges = frame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", None)])
    pairs = tree.closure(edges)
    assert {(r["node"], r["depth"], r["path"], r["n_below"]) for r in tree.laid_out(pairs).collect()} == {("a", 0, "a", 3), ("b", 1, "a/b", 2), ("c", 2, "a/b/c", 0), ("d", 2, "a/b/d", 0), ("x", 0, "x", 0)}
    assert [tuple(r) for r in tree.descendants(pairs, "a").collect()] == [("b", 1), ("c", 2), ("d", 2)]
    assert [r["child"] for r in tree.children(edges, "b").collect()] == ["c", "d"] and [r["child"] for r in tree.children(edges, None).collect()] == ["a", "x"]
    sums = tree.subtree_sums(pairs, spark.createDataFrame([("c", 2), ("c", 3), ("b", 10)], "node string, value long"))
    assert {r["node"]: r["total"] for r in sums.collect()} == {"a": 15, "b": 15, "c": 5}
    for bad in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", None), ("a", "a")], [("a", "z")]):
        with pytest.raises(ValueError):
            tree.closure(frame(bad))


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "skills.json"
    good = {"skills": [{"slug": "go", "name": "Go", "category": "language", "parent": "backend", "ambiguous": True}, {"slug": "ada", "parent": "backend", "category": "language"}], "groups": [{"slug": "backend", "parent": "it"}, {"slug": "it"}]}
    path.write_text(json.dumps(good))
    found = skillmatch.load(spark, str(path))
    assert found.path("backend") == ["backend", "it"] and [s.slug for s in found.by_category()["language"]] == ["ada", "go"]
    assert {(r["node"], r["path"]) for r in tree.laid_out(tree.closure(found.edges(spark))).collect()} == {("it", "it"), ("backend", "it/backend"), ("go", "it/backend/go"), ("ada", "it/backend/ada")}
    for skills, groups in (([{"slug": "Go"}], []), ([{"slug": "go"}, {"slug": "go"}], []), ([{"slug": "go", "parent": "no"}], []), ([], [{"slug": "a", "parent": "b"}, {"slug": "b", "parent": "a"}]), ([], [{"slug": "a"}, {"slug": "a"}])):
        path.write_text(json.dumps({"skills": skills, "groups": groups}))
        with pytest.raises(ValueError):
            skillmatch.load(spark, str(path))


def test_row_numbers_are_stable(spark, tmp_path):
    path = tmp_path / "jobs.jsonl"
    text = "".join(json.dumps({"id": k, "pad": "x" * (k % 50)}) + "\n" + ("\n" if k % 10 == 9 else "") for k in range(400))
    path.write_text(text)
    rows = lambda: {r["id"]: r["row"] for r in files.scan(spark, str(path)).selectExpr("try_variant_get(payload, '$.id', 'int') id", "row").collect()}
    want = {k: k + k // 10 for k in range(400)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1g", "4k", "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows() == want, size
        path.write_text(text + "".join(json.dumps({"id": k}) + "\n" for k in range(400, 450)))
        assert {k: v for k, v in rows().items() if k < 400} == want
        assert sorted(r["id"] for r in files.scan(spark, str(path)).filter("row >= 440").selectExpr("try_variant_get(payload, '$.id', 'int') id").collect()) == list(range(400, 450))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_counts_from_footers(spark, tmp_path):
    root = str(tmp_path / "store")
    jobs = spark.range(50).select(F.col("id").cast("string").alias("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("id") % 3).cast("int"))).alias("published_at"), F.array(F.lit("go")).alias("skills"))
    files.export(jobs, root)
    counted = files.partitions(spark, root)
    assert {(r["year"], r["month"], r["day"]): r["n"] for r in counted.collect()} == {(2024, 1, 1): 17, (2024, 1, 2): 17, (2024, 1, 3): 16} and files.row_count(spark, root) == 50
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert files.query(spark, root, "WITH a AS (SELECT count(*) AS n FROM jobs) SELECT n FROM a").first()["n"] == 50
    for bad in ("DELETE FROM jobs", "WITH a AS (SELECT 1) INSERT INTO jobs SELECT * FROM a", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(Exception, match="only queries|mismatch|Syntax|PARSE"):
            files.query(spark, root, bad)
