"""A paged JSON API as a Python data source, for batches and streams, with a guarded client, and presets of career pages."""

from __future__ import annotations

import ipaddress
import json
import socket
import time
import urllib.request
from collections.abc import Iterator
from itertools import islice
from urllib.error import HTTPError
from urllib.parse import urlencode, urljoin, urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources import mapping as mp

MAX_BYTES, TRIES, REDIRECTS, AGENT = 16 << 20, 3, 5, "tidemark"
# URL templates and field paths of two hiring systems.
PRESETS = {
    "greenhouse": {"url": "https://boards-api.greenhouse.io/v1/boards/{board}/jobs?content=true", "records": "jobs", "mapping": {"source_job_id": "id", "url": "absolute_url", "title": "title", "description": "content", "location": "location.name"}},
    "lever": {"url": "https://api.lever.co/v0/postings/{board}?mode=json", "records": "", "mapping": {"source_job_id": "id", "url": "hostedUrl", "title": "text", "description": "descriptionPlain", "location": "categories.location", "employment_type": "categories.commitment"}},
}


def guarded(url: str, private: bool = False) -> str:
    """The URL, if it is http(s) and its host resolves to public addresses only."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username:
        raise ValueError("only plain http(s) URLs are fetched")
    if not private:
        for info in socket.getaddrinfo(parts.hostname, parts.port or 443):
            if not ipaddress.ip_address(info[4][0]).is_global:
                raise ValueError("the host isn't public")
    return url


class _Answers(urllib.request.HTTPRedirectHandler):
    """Redirects and 304 come back as answers, so that each new address is checked before it is asked."""

    def redirect_request(self, *args):
        return None


_OPENER = urllib.request.build_opener(_Answers)
_ROBOTS: dict[str, RobotFileParser] = {}
_NEXT: dict[str, float] = {}


def _open(url: str, headers: dict[str, str], private: bool, per_second: float | None) -> tuple[int, bytes, dict[str, str]]:
    """One request, not before the host's turn: (status, body, headers)."""
    host = urlsplit(guarded(url, private)).netloc
    if per_second:
        now = time.monotonic()
        turn = max(now, _NEXT.get(host, now))
        _NEXT[host] = turn + 1 / per_second
        time.sleep(turn - now)
    try:
        with _OPENER.open(urllib.request.Request(url, headers={"User-Agent": AGENT, **headers}), timeout=20) as answer:
            status, body, got = answer.status, answer.read(MAX_BYTES + 1), answer.headers
    except HTTPError as error:
        if error.code >= 500 or error.code == 429:
            raise
        status, body, got = error.code, b"", error.headers
    if len(body) > MAX_BYTES:
        raise ValueError("the answer is too large")
    return status, body, {k.lower(): v for k, v in got.items()}


def allowed(url: str, private: bool = False) -> bool:
    """Whether the host's robots.txt lets this client read the URL; read once a host and process, all is allowed without one."""
    parts = urlsplit(url)
    base = f"{parts.scheme}://{parts.netloc}"
    if base not in _ROBOTS:
        status, body, _ = _open(f"{base}/robots.txt", {}, private, None)
        rules = RobotFileParser()
        rules.parse(body.decode("utf-8", "replace").splitlines() if status == 200 else [])
        _ROBOTS[base] = rules
    return _ROBOTS[base].can_fetch(AGENT, url)


def answer(url: str, private: bool = False, etag: str = "", robots: bool = True, per_second: float | None = None) -> tuple[int, object, str]:
    """(status, JSON or None, ETag) of a URL: status 304 if ``etag`` still holds, else 200.

    Every address of a chain of at most five redirects is checked like the first; waits of 0.5, 1, 2 seconds between tries.
    """
    headers = {"Accept": "application/json"} | ({"If-None-Match": etag} if etag else {})
    for k in range(TRIES):
        try:
            at = url
            for _ in range(REDIRECTS + 1):
                if robots and not allowed(at, private):
                    raise PermissionError(f"robots.txt of {urlsplit(at).netloc} forbids {urlsplit(at).path}")
                status, body, got = _open(at, headers, private, per_second)
                if status not in (301, 302, 303, 307, 308):
                    break
                at = urljoin(at, got.get("location", ""))
            if status == 304:
                return 304, None, etag
            if status != 200:
                raise ValueError(f"the answer has status {status}")
            return 200, json.loads(body), got.get("etag", "")
        except PermissionError:
            raise
        except OSError:
            if k == TRIES - 1:
                raise
            time.sleep(0.5 * 2**k)
    raise AssertionError("unreachable")


def fetch(url: str, private: bool = False) -> object:
    """JSON at a URL."""
    return answer(url, private)[1]


def records_of(payload: object, path: str | None) -> list:
    """Records at a dotted path, else the payload itself, else its first list."""
    for part in (path or "").split(".") if path else []:
        payload = payload.get(part) if isinstance(payload, dict) else None
    if isinstance(payload, list):
        return payload
    return next((v for v in payload.values() if isinstance(v, list)), []) if isinstance(payload, dict) else []


MODES = ("none", "page", "offset", "cursor")


class Paging:
    """How a listing is walked, from options; a page is named by a cursor: its number, the number of its first row, or what the page before said.

    Options: url, records (dotted path), pagination (none, page, offset, cursor), size, cursor_path and cursor_param, since and since_param,
    since_field, private, robots, per_second. An unknown pagination is refused.
    """

    def __init__(self, options: dict) -> None:
        o = self.options = dict(options)
        self.mode, self.size = o.get("pagination", "none"), int(o.get("size", 100))
        if self.mode not in MODES:
            raise ValueError(f"pagination is one of {', '.join(MODES)}")
        if self.size < 1 or not o.get("url"):
            raise ValueError("a url and a positive size are needed")
        self.first = {"none": "", "page": "1", "offset": "0", "cursor": ""}[self.mode]

    def ask(self, cursor: str, etag: str = "", since: str = "") -> tuple[int, list, str, str]:
        """(status, records, cursor of the next page or empty, ETag) of one page."""
        o = self.options
        extra = {"none": {}, "page": {"page": cursor, "per_page": self.size}, "offset": {"offset": cursor, "limit": self.size}, "cursor": {"limit": self.size}}[self.mode]
        if self.mode == "cursor" and cursor:
            extra[o.get("cursor_param", "cursor")] = cursor
        if since:
            extra[o.get("since_param", "since")] = since
        url = o["url"] + (("&" if "?" in o["url"] else "?") + urlencode(extra) if extra else "")
        rate = float(o["per_second"]) if o.get("per_second") else None
        status, payload, tag = answer(url, o.get("private", "false") == "true", etag, o.get("robots", "true") == "true", rate)
        found = records_of(payload, o.get("records") or None)
        return status, found, self.following(payload, cursor, len(found)), tag

    def following(self, payload: object, cursor: str, n: int) -> str:
        if self.mode == "cursor":
            for part in self.options.get("cursor_path", "next").split("."):
                payload = payload.get(part) if isinstance(payload, dict) else None
            return str(payload) if payload not in (None, "", cursor) else ""
        step = {"page": 1, "offset": self.size}.get(self.mode, 0)
        return str(int(cursor) + step) if step and n >= self.size else ""

    def row(self, cursor: str) -> int:
        """The number of a page's first row where the cursor tells it, else 0."""
        return (int(cursor) - 1) * self.size if self.mode == "page" else int(cursor) if self.mode == "offset" else 0


class JsonApi(DataSource):
    """A JSON listing, whole (``limit`` rows at most if given) or as a stream of what is new; see ``Paging`` for the options.

    With ``total``, the dotted path of the number of all records, pages of a batch read are dealt to tasks.
    A stream reads at most ``pages`` pages a micro-batch, each by a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "row bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return JsonApiReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return JsonApiStream(self.options)


class Pages(InputPartition):
    """Pages from a cursor on: ``most`` of them, or all; of a single page the records ``begin`` to ``end``."""

    def __init__(self, cursor: str, most: int | None = None, begin: int = 0, end: int | None = None, since: str = "") -> None:
        self.cursor, self.most, self.begin, self.end, self.since = cursor, most, begin, end, since


def _rows(paging: Paging, pages: Pages) -> Iterator[tuple]:
    cursor, done, sent = pages.cursor, 0, 0
    while pages.most is None or done < pages.most:
        _, found, after, _ = paging.ask(cursor, since=pages.since)
        base = sent if paging.mode == "cursor" and pages.most is None else paging.row(cursor)
        for k, record in enumerate(found[pages.begin : pages.end]):
            yield base + pages.begin + k, json.dumps(record)
        sent, done, cursor = sent + len(found), done + 1, after
        if not after:
            return


class JsonApiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paging = Paging(options)
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.total, self.pages = options.get("total"), int(options.get("pages", 10))

    def partitions(self) -> list[InputPartition]:
        p, o = self.paging, self.paging.options
        since = o.get("since", "")
        if not self.total or p.mode not in ("page", "offset") or self.limit is not None:
            return [Pages(p.first, since=since)]
        whole = Paging(dict(o) | {"records": "", "size": str(p.size)})
        value = answer(whole.options["url"] + ("&" if "?" in o["url"] else "?") + urlencode({"page": 1, "per_page": p.size} if p.mode == "page" else {"offset": 0, "limit": p.size}), o.get("private", "false") == "true", robots=o.get("robots", "true") == "true")[1]
        for part in self.total.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        count = -(-int(value or 0) // p.size) or 1
        step = 1 if p.mode == "page" else p.size
        starts = range(0, count, self.pages)
        # the last task goes on to the end, in case the listing has grown
        return [Pages(str(int(p.first) + k * step), self.pages if k + self.pages < count else None, since=since) for k in starts]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return islice(_rows(self.paging, partition), self.limit)


class JsonApiStream(DataSourceStreamReader):
    """New records of a listing that grows at its end, or of one that is asked with ``since``.

    The offset is the cursor of the last page seen, how many of its records were, its ETag, and the greatest ``since_field`` so far, with the
    pages that led there. It is all that the checkpoint needs to go on. The driver asks pages to learn how far the listing goes,
    the tasks fetch their records. An ETag that still holds (304) means that nothing is new.
    """

    def __init__(self, options: dict) -> None:
        self.paging, self.pages = Paging(options), int(options.get("pages", 10))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        start = {"cursor": self.paging.first, "seen": 0, "etag": "", "since": self.paging.options.get("since", ""), "pages": "[]"}
        if self.at is None:
            self.at = start
        return start

    def latestOffset(self) -> dict:
        at = self.at if self.at is not None else self.initialOffset()
        field = self.paging.options.get("since_field")
        cursor, seen, etag, since, asked = at["cursor"], at["seen"], at["etag"], at["since"], at["since"]
        pages: list = []
        while len(pages) < self.pages:
            status, found, after, tag = self.paging.ask(cursor, etag if not pages else "", asked)
            if status == 304:
                break
            whole = self.paging.mode == "none"
            begin = 0 if whole else seen
            if len(found) > begin:
                pages.append([cursor, begin, len(found), asked])
                if field:
                    since = max([since, *[str(r[field]) for r in found if isinstance(r, dict) and r.get(field) is not None]])
            etag, seen = tag, 0 if whole else len(found)
            if field and not after:
                # what comes next is asked by ``since`` from the first page on
                if since != asked:
                    cursor, seen, etag = self.paging.first, 0, ""
                break
            if not after:
                break
            cursor, seen, etag = after, 0, ""
        if not pages:
            return at
        self.at = {"cursor": cursor, "seen": seen, "etag": etag, "since": since if field and cursor == self.paging.first else asked, "pages": json.dumps(pages)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:  # a restart: the last batch of the log is planned first
            self.at = end
        return [] if start == end else [Pages(c, 1, a, b, s) for c, a, b, s in json.loads(end["pages"])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.paging, partition)


def stream(spark: SparkSession, source: str, url: str, mapping: dict[str, str] | None = None, defaults: dict[str, str] | None = None, **options: str) -> DataFrame:
    """The raw records of ``read`` as a stream of what is new; the checkpoint of its query is the cursor."""
    spark.dataSource.register(JsonApi)
    return _raw(spark.readStream.format("json_api").options(url=url, **options).load(), source, url, mapping, defaults)


def read(spark: SparkSession, source: str, url: str, mapping: dict[str, str] | None = None, defaults: dict[str, str] | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(JsonApi)
    return _raw(spark.read.format("json_api").options(url=url, **options).load(), source, url, mapping, defaults)


def _raw(rows: DataFrame, source: str, url: str, mapping: dict[str, str] | None, defaults: dict[str, str] | None) -> DataFrame:
    parsed = rows.select(F.try_parse_json("payload").alias("payload"), F.lit(url).alias("file"), "row")
    return mp.to_raw(parsed, source, "api", mapping, None, defaults)


def career_page(spark: SparkSession, provider: str, board: str, company: str, **options: str) -> DataFrame:
    """A preset with the company as default."""
    p = PRESETS[provider]
    return read(spark, f"{provider}:{board}", p["url"].format(board=board), p["mapping"], {"company": company}, records=p["records"], **options)
