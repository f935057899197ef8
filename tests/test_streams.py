"""Near-duplicates and the event processor as streams, with restarts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_stored import texts
from tidemark import tables
from tidemark.operators import dedup
from tidemark.streaming import events as ev
from tidemark.streaming import jobs as st
from tidemark.streaming import neardup

START = datetime(2024, 3, 1)
SCHEMA = "id long, ord long, published_at timestamp, text string"


@pytest.fixture
def rocks(spark):
    for k, v in neardup.STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k in neardup.STATE:
        spark.conf.unset(k)


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps({"id": i, "ord": o, "published_at": t.strftime("%Y-%m-%dT%H:%M:%S"), "text": x}) + "\n" for i, o, t, x in rows))


def test_near_window(rocks, tmp_path):
    spark, source = rocks, tmp_path / "in"
    source.mkdir()
    found = texts(36, 9, 120)
    rows = [(k, k, START + timedelta(hours=6 * k), t) for k, t in enumerate(found)] + [(36, 36, START + timedelta(days=9), found[4]), (37, 37, START + timedelta(days=9), None)]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        return st.run_once(neardup.near_pairs(stream), "", str(tmp_path / "ck"), batch=neardup.resolving(str(tmp_path / "out")))

    write(source, "a.json", rows[:20])
    run()
    write(source, "b.json", rows[20:])
    held = run()  # a new query on the old checkpoint
    got = {r["id"]: r["duplicate_of"] for r in neardup.verdicts(spark, str(tmp_path / "out")).collect()}
    signed = spark.createDataFrame(rows, SCHEMA).select("id", "ord", dedup.signature("text").alias("sig"))
    want = {r["id"]: r["duplicate_of"] for r in dedup.greedy(dedup.near_pairs(signed)).collect()}
    assert got == want and got[36] == 4 and 37 not in got and len(got) >= 12
    state = lambda q: max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    before = state(held)
    # sixty days later all of that has left, and an old text is new again
    write(source, "c.json", [(50, 50, START + timedelta(days=60), "late text of few words one two three")])
    run()
    write(source, "d.json", [(51, 51, START + timedelta(days=61), found[4]), (52, 52, START + timedelta(days=61), found[4])])
    last = run()
    got = {r["id"]: r["duplicate_of"] for r in neardup.verdicts(spark, str(tmp_path / "out")).collect()}
    assert 51 not in got and got[52] == 51
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] < before / 3


def test_retries_and_dead_letters(spark, tmp_path):
    source, retry, dead = tmp_path / "in", str(tmp_path / "retry"), str(tmp_path / "dead")
    source.mkdir()
    event = lambda k, kind, job: json.dumps({"event_id": f"e{k}", "event_type": kind, "occurred_at": "2024-03-01T00:00:00", "job_id": job, "attempt": 0})
    wires = [event(1, "seen", "j1"), event(2, "seen", "j2"), event(3, "seen", "poison"), event(4, "flaky", "j4"), event(5, "unknown", "j5"), "{broken"]
    (source / "a.json").write_text("".join(json.dumps({"key": None, "value": w}) + "\n" for w in wires))
    table = tables.KeyedTable.create(spark, tables.fresh(spark, "t"), spark.createDataFrame([], "job_id string, event_id string").schema, ["job_id"], 2)
    put, calls = tables.upserting(table, "event_id", "seen"), []

    def seen(batch, batch_id):
        good = batch.filter("job_id <> 'poison'").select("job_id", "event_id")
        put(good, batch_id)
        return batch.filter("job_id = 'poison'").select("event_id", F.lit("poison").alias("error"))

    def flaky(batch, batch_id):
        calls.append(batch_id)
        if len(calls) < 2:
            raise RuntimeError("down")

    handle = ev.processing({"seen": seen, "flaky": flaky}, retry, dead)
    for _ in range(4):
        wire = spark.readStream.schema("key string, value string").json(str(source))
        st.run_once(ev.with_retries(spark, wire, retry), "", str(tmp_path / "ck"), batch=handle)
    letters = {(r["event_id"], r["error"], r["attempt"]) for r in ev.dead_letters(spark, dead).collect()}
    assert letters == {("e3", "poison", 3), (None, "no handler", None), (None, "undecodable", None)} and len(calls) == 2
    assert {(r["job_id"], r["event_id"]) for r in table.read().collect()} == {("j1", "e1"), ("j2", "e2")}
    # a batch that is replayed writes nothing again
    before = sorted(p.name for p in (tmp_path / "retry").rglob("*.json"))
    batch = spark.createDataFrame([(w,) for w in wires], "value string").select("value", F.from_json("value", st.EVENT).alias("e")).select("value", "e.*")
    handle(batch, 0)
    assert sorted(p.name for p in (tmp_path / "retry").rglob("*.json")) == before


def test_merge_batches_keeps_one_row_a_key(spark, tmp_path):
    rng = random.Random(3)
    put = st.merge_batches(str(tmp_path / "merged"), ["k"], "t")
    rows = [(rng.randrange(5), t, f"v{t}") for t in range(30)]
    for batch_id, part in [(0, rows[:10]), (1, rows[10:20]), (1, rows[10:20]), (2, rows[20:])]:
        put(spark.createDataFrame(part, "k long, t long, v string"), batch_id)
    want = {k: max((t, v) for j, t, v in rows if j == k) for k, _, _ in rows}
    got = tables.KeyedTable(spark, str(tmp_path / "merged")).read().collect()
    assert len(got) == len(want) and {r["k"]: (r["t"], r["v"]) for r in got} == want
