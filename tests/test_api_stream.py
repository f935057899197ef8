"""The API source against a stub server on this machine: paging, limits of a client, and streams with restarts."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tidemark.sources import api
from tidemark.streaming import jobs as st


class Stub(BaseHTTPRequestHandler):
    records: list = []
    asked: list = []
    moved = ""

    def log_message(self, *args):
        pass

    def do_GET(self):
        at, q = urlsplit(self.path), {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        Stub.asked.append((at.path, self.headers.get("If-None-Match")))
        if at.path == "/robots.txt":
            return self.say(200, b"User-agent: *\nDisallow: /secret\n")
        if at.path == "/moved":
            self.send_response(302)
            self.send_header("Location", Stub.moved)
            self.end_headers()
            return None
        rows = [r for r in Stub.records if not q.get("since") or r["updated"] > q["since"]]
        body: dict = {"meta": {"total": len(rows)}}
        if at.path == "/pages":
            size, page = int(q["per_page"]), int(q["page"])
            body["jobs"] = rows[(page - 1) * size : page * size]
        elif at.path == "/offsets":
            body["jobs"] = rows[int(q["offset"]) :][: int(q["limit"])]
        elif at.path == "/cursors":
            begin = int(q.get("cursor", "0x")[:-1])
            end = begin + int(q["limit"])
            body |= {"jobs": rows[begin:end], "paging": {"next": f"{end}x" if end < len(rows) else None}}
        else:
            body["jobs"] = rows
        raw = json.dumps(body).encode()
        tag = f'"{hash(raw)}"'
        if self.headers.get("If-None-Match") == tag:
            return self.say(304, b"", tag)
        return self.say(200, raw, tag)

    def say(self, status, body, tag=None):
        self.send_response(status)
        if tag:
            self.send_header("ETag", tag)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    Stub.records, Stub.asked = [], []
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


def fill(a, b):
    Stub.records = Stub.records + [{"id": k, "title": f"Role {k}", "description": "text", "company": "Acme", "updated": f"2024-01-{k // 100 + 10}T{k % 100:02d}"} for k in range(a, b)]


WAYS = {"/pages": {"pagination": "page", "records": "jobs"}, "/offsets": {"pagination": "offset", "records": "jobs"}, "/cursors": {"pagination": "cursor", "records": "jobs", "cursor_path": "paging.next"}}


@pytest.mark.parametrize("path", WAYS)
def test_all_pages_are_read(spark, base, path):
    fill(0, 53)
    ids = lambda **o: sorted(int(r.source_job_id) for r in api.read(spark, "stub", base + path, private="true", size="10", **WAYS[path], **o).collect())
    assert ids() == list(range(53)) and ids(limit="7") == list(range(7))
    if path != "/cursors":
        many = api.read(spark, "stub", base + path, private="true", size="10", total="meta.total", pages="2", **WAYS[path])
        assert many.rdd.getNumPartitions() == 3 and sorted(int(r.source_job_id) for r in many.collect()) == list(range(53))


def test_modes_are_checked(spark, base):
    with pytest.raises(Exception, match="pagination is one of"):
        api.read(spark, "stub", base + "/pages", private="true", pagination="pages").collect()


def test_client(base):
    fill(0, 2)
    status, payload, tag = api.answer(base + "/all", True)
    assert status == 200 and len(payload["jobs"]) == 2 and api.answer(base + "/all", True, tag)[0] == 304
    with pytest.raises(PermissionError):
        api.answer(base + "/secret/x", True)
    Stub.moved = "/all"
    assert len(api.answer(base + "/moved", True)[1]["jobs"]) == 2
    Stub.moved = "file:///etc/passwd"  # where a redirect leads is checked too
    with pytest.raises(ValueError):
        api.answer(base + "/moved", True)
    begin = time.monotonic()
    for _ in range(3):
        api.answer(base + "/all", True, per_second=20)
    assert time.monotonic() - begin > 0.09


@pytest.mark.parametrize("path", [*WAYS, "/all"])
def test_stream_goes_on_where_it_stopped(spark, base, tmp_path, path):
    options = WAYS.get(path, {"records": "jobs", "since_field": "updated"})

    def run(times=1):
        Stub.asked.clear()
        raw = api.stream(spark, "stub", base + path, private="true", size="10", pages="4", **options)
        batches: list = []
        for _ in range(times):  # a run takes at most ``pages`` pages
            st.run_once(raw, "", str(tmp_path / "ck"), batch=lambda df, i: batches.append((df.rdd.getNumPartitions(), sorted(int(r.source_job_id) for r in df.collect()))))
        return batches

    fill(0, 53)
    first = run(1 if path == "/all" else 2)
    assert sorted(k for _, ids in first for k in ids) == list(range(53))
    assert path == "/all" or max(n for n, _ in first) > 1  # several tasks
    assert [ids for _, ids in run() if ids] == []  # nothing new: no rows
    assert path == "/all" or any(tag for _, tag in Stub.asked)  # it was asked with the ETag
    fill(53, 75)
    assert sorted(k for _, ids in run() for k in ids) == list(range(53, 75))
