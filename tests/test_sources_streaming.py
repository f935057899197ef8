"""Sources, sinks, dedup, skills and streaming on small inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, maintenance, quality, skillmatch
from tidemark.sources import api, feeds, files, mapping, registry, synthetic
from tidemark.streaming import jobs as st

NOW = datetime(2024, 6, 1)


def variant(spark, payload):
    return spark.createDataFrame([(json.dumps(payload),)], "j string").select(F.parse_json("j").alias("payload"))


@pytest.mark.parametrize("path,expected", [("a.b", "1"), ("list.0.name", "first"), ("list.-1.name", "second"), ("missing", None), ("a.b.c", None)])
def test_paths(spark, path, expected):
    row = variant(spark, {"a": {"b": 1}, "list": [{"name": "first"}, {"name": "second"}]})
    assert row.select(mapping.stringify(mapping.extract_path(F.col("payload"), path)).alias("x")).first().x == expected


@pytest.mark.parametrize("value,expected", [("  text  ", "text"), (42, "42"), (True, "true"), ({"name": "Acme"}, "Acme"), (["a", "b"], "a, b"), ("", None)])
def test_stringify(spark, value, expected):
    row = variant(spark, {"v": value})
    assert row.select(mapping.stringify(mapping.extract_path(F.col("payload"), "v")).alias("x")).first().x == expected


def test_jsonl_resume_and_csv(spark, tmp_path):
    path = tmp_path / "jobs.jsonl"
    path.write_text("".join(json.dumps({"id": i, "title": f"Role {i}", "description": "text", "company": "Acme"}) + "\n" for i in range(7)))
    rows = files.dataset(spark, str(path), "file")
    assert rows.count() == 7 and files.dataset(spark, str(path), "file", after=4).count() == 2
    table = tmp_path / "jobs.csv"
    table.write_text("id,title,description,company\n1,Engineer,Body,Acme\n2,,Body,Acme\n")
    got = files.dataset(spark, str(table), "file", roots=[str(tmp_path)]).collect()
    assert [r.title for r in got] == ["Engineer"] and got[0].company == "Acme"
    with pytest.raises(ValueError):
        files.within("/etc/passwd", [str(tmp_path)])
    listed = tmp_path / "jobs.json"
    listed.write_text(json.dumps({"jobs": [{"url": "https://x.example", "title": "A"}, {"title": "B"}]}))
    assert sorted(r.source_job_id.split("-")[0] for r in files.dataset(spark, str(listed), "file").collect()) == ["https://x.example", "jobs"]


def test_feed(spark):
    feed = "<rss><channel><item><title>Engineer</title><link>https://x.example/1</link><description>&lt;p&gt;Hello&lt;/p&gt;</description><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate><dc:creator>Acme</dc:creator></item></channel></rss>"
    bad = '<!DOCTYPE x [<!ENTITY e "v">]><rss><item><title>Bad</title></item></rss>'
    got = feeds.entries(spark.createDataFrame([(feed,), (bad,)], "document string"), "feed").collect()
    assert len(got) == 1 and got[0].source_job_id == "https://x.example/1" and got[0].description == "Hello" and got[0].company == "Acme" and got[0].published_at.year == 2024


def test_api_helpers():
    assert api.records_of({"a": {"b": [1]}}, "a.b") == [1] and api.records_of({"n": 1, "jobs": [2]}, None) == [2]
    for url in ("file:///etc/passwd", "http://127.0.0.1/x", "http://user@example.com/"):
        with pytest.raises(ValueError):
            api.guarded(url)
    with pytest.raises(ValueError):
        registry.Registry([registry.Definition("a", "nothing")])


def test_synthetic_trends(spark):
    df = synthetic.postings(spark, 3000, NOW, 120).persist()
    late = F.col("published_at") > F.lit("2024-04-02").cast("timestamp")
    n = {s: df.filter(F.contains("description", F.lit(s))).agg(F.count_if(late), F.count_if(~late)).first() for s in ("FastAPI", "COBOL")}
    assert n["FastAPI"][0] > 1.3 * n["FastAPI"][1] and n["COBOL"][0] < 0.8 * n["COBOL"][1]
    assert df.filter("source = 'mirror'").count() > 0 and df.filter("title IS NULL").count() > 0
    assert df.exceptAll(synthetic.postings(spark, 3000, NOW, 120)).count() == 0


def test_dedup_kinds(spark):
    body = " ".join(f"sentence number {i} tells about work {i * 7}" for i in range(40))
    rows = [
        ("a", 1, "s1/1", "u1", "h1", body), ("b", 2, "s1/1", "u2", "h2", "other text of the second record"), ("c", 3, "s2/3", "u1", "h3", "third"),
        ("d", 4, "s3/4", "u4", "h1", "fourth"), ("e", 5, "s4/5", "u5", "h5", "intro " + body), ("f", 6, "s5/6", "u6", "h6", ""),
    ]
    df = spark.createDataFrame(rows, "id string, ord int, natural_key string, url_fingerprint string, content_hash string, text string")
    got = {r.id: (r.kind, r.duplicate_of) for r in dedup.dedup(df, 0.7, 32).collect()}
    assert got == {"a": (None, None), "b": ("exact_source", "a"), "c": ("url", "a"), "d": ("content", "a"), "e": ("near", "a"), "f": (None, None)}
    rates = {r.kind: r.n for r in dedup.statistics(dedup.dedup(df, 0.7, 32)).collect()}
    assert rates["unique"] == 2


def test_greedy_settles_a_long_chain(spark):
    pairs = spark.createDataFrame([(i + 1, i, 0.9, i) for i in range(54)], "later long, earlier long, score double, ord long")
    assert {r.id: r.duplicate_of for r in dedup.greedy(pairs).collect()} == {i: i - 1 for i in range(1, 55, 2)}


def test_greedy_is_not_transitive(spark):
    pairs = spark.createDataFrame([("b", "a", 0.9, 1), ("c", "b", 0.9, 2), ("d", "c", 0.9, 3)], "later string, earlier string, score double, ord int")
    assert {r.id: r.duplicate_of for r in dedup.greedy(pairs).collect()} == {"b": "a", "d": "c"}


def test_skills(spark):
    text = "We build services.\nRequirements\nPython, FastAPI and PostgreSQL with Docker\nNice to have\nTerraform"
    run = lambda title, body: {s["slug"]: s.asDict() for s in spark.createDataFrame([(title, body)], "t string, b string").select(skillmatch.extract(F.col("t"), F.col("b"), least=0.0)).first()[0]}
    found = run("Python Engineer", text)
    assert found["python"]["is_required"] is True and found["terraform"]["is_required"] is False and {"fastapi", "postgresql", "docker"} <= set(found)
    assert "go" not in run("", "We go to the office daily.") and "go" in run("", "Stack: Python, Go, Rust")
    assert not {"cpp", "c"} & set(run("", "Series C round")) and {"cpp", "csharp"} <= set(run("", "Stack: C++, C# and Python"))
    df = spark.createDataFrame([("Python Engineer", text), (None, None)], "t string, b string")
    got = df.select(skillmatch.top(skillmatch.extract(F.col("t"), F.col("b")), 2).alias("s")).collect()
    assert got[0].s[0].slug == "python" and got[1].s == []
    # places are those of the text: a name before, inside and after the sections, twice, at either end
    body = "kafka first\n  Qualifications: see below\nDocker, docker and Kafka\nBonus\nRust or k8s"
    found = run("", body)
    assert [(found[s]["is_required"], found[s]["occurrences"]) for s in ("kafka", "docker", "rust", "kubernetes")] == [(True, 2), (True, 2), (False, 1), (False, 1)]
    assert found["docker"]["confidence"] == pytest.approx(0.55 + 0.07 + 0.15 + 0.08) and found["kubernetes"]["confidence"] == pytest.approx(0.5)
    assert run("Rust", "Rust")["rust"]["confidence"] == pytest.approx(0.83) and run("Rust", "")["rust"]["confidence"] == pytest.approx(0.78)
    assert run("", "C/C++ developer")["c"]["confidence"] == pytest.approx(0.53) and "c" not in run("", "vitamin C")
    assert run("Rust", "Bonus\nRust")["rust"]["is_required"] is True and run(None, "pythonic rusty dockers") == {}
    with pytest.raises(ValueError):
        skillmatch.Taxonomy([], {"a": "b", "b": "a"})


def test_store(spark, tmp_path):
    jobs = spark.createDataFrame([("1", ["b", "a", "a"], NOW), ("2", [], NOW)], "id string, skills array<string>, published_at timestamp")
    root = str(tmp_path / "store")
    files.export(jobs, root)
    files.export(jobs, root)  # a repeat replaces its partitions
    assert files.row_count(spark, root) == 2 and files.partitions(spark, root).count() == 1
    got = files.query(spark, root, "SELECT skills FROM jobs WHERE id = :id", {"id": "1"}).first()
    assert got.skills == ["a", "b"]
    with pytest.raises(ValueError):
        files.query(spark, root, "DROP TABLE jobs")


def test_quality(spark):
    dims = spark.createDataFrame([("s", 1.0, 0.85, 0.5, 1.0, 0.6, 0.2)], "source string, completeness double, validity double, uniqueness double, consistency double, accuracy double, freshness double")
    row = quality.graded(dims).first()
    assert row.score == pytest.approx(0.25 + 0.17 + 0.075 + 0.15 + 0.09 + 0.02) and row.grade == "C"
    assert {r.dimension: r.severity for r in quality.events(dims).collect()} == {"validity": "warning", "uniqueness": "warning", "freshness": "error"}


def test_upsert(spark):
    schema = "id string, source string, status string, content_hash string, first_seen_at timestamp"
    old = spark.createDataFrame([("1", "s", "expired", "x", NOW), ("2", "s", "active", "x", NOW)], schema)
    new = spark.createDataFrame([("1", "s", "active", "x", NOW), ("2", "s", "active", "y", NOW), ("3", "s", "active", "z", NOW)], schema)
    merged = maintenance.upsert(old, new, ["id"])
    assert {r.id: r.status for r in merged.collect()} == {"1": "active", "2": "updated", "3": "active"}
    assert {r.id: r.status for r in maintenance.upsert(merged, new, ["id"]).collect()} == {"1": "active", "2": "updated", "3": "active"}


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    synthetic.postings(spark, 60, NOW, 20).withColumn("url", F.concat(F.lit("https://x.example/"), F.substring_index("url", "?", 1))).repartition(3).write.json(str(folder))
    raw = st.raw_files(spark, str(folder))
    found = st.accepted(raw, NOW).select("source", "source_job_id", "url", "published_at")
    st.run_once(st.distinct(found, ["url"]), str(tmp_path / "out"), str(tmp_path / "ck1"))
    once = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < once.count() == once.select("url").distinct().count() < 60
    seen = []
    st.run_once(found, "", str(tmp_path / "ck2"), batch=lambda df, i: seen.append(df.count()))
    assert sum(seen) == spark.read.schema(raw.schema).json(str(folder)).filter("title IS NOT NULL").count()
    st.run_once(found, "", str(tmp_path / "ck3"), batch=st.merge_batches(str(tmp_path / "merged"), ["url"], "published_at"))
    assert spark.read.parquet(str(tmp_path / "merged")).count() >= once.count()


def test_events(spark):
    event = spark.createDataFrame([("1", "job.created", NOW, "j", None, "s", 2, {"k": "v"})], "event_id string, event_type string, occurred_at timestamp, job_id string, run_id string, source string, attempt int, payload map<string,string>")
    back = st.decode(st.encode(event))
    assert back.first().payload == {"k": "v"}
    again, dead = st.retried(back)
    assert (again.count(), dead.count()) == (0, 1)
