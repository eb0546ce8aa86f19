"""The paced reader and sources that fail while their job runs."""

import io
import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import textops
from tallyloom.sources import readers

ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private # closed\nDisallow:\nuser-agent: TallyLoom\ndisallow: /drafts/\n"


class Web:
    """A web whose clock moves only when someone sleeps or asks for a page."""

    def __init__(self, broken=()):
        self.now, self.asked, self.broken = 0.0, [], set(broken)

    def clock(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds

    def open(self, request, timeout):
        self.asked.append((self.now, request.full_url))
        self.now += 0.2
        if request.full_url in self.broken:
            raise urllib.error.URLError("down")
        if request.full_url.endswith("/gone"):
            raise urllib.error.HTTPError(request.full_url, 404, "gone", {}, io.BytesIO())
        body = ROBOTS if request.full_url.endswith("/robots.txt") else f"page {request.full_url}"
        return io.BytesIO(body.encode())


def read(web, urls, **options):
    reader = readers.PageReader({"urls": json.dumps(urls), **options}, web.open, web.clock, web.sleep)
    return reader, [row for part in reader.partitions() for row in reader.read(part)]


def test_pace_of_three_hosts():
    web = Web()
    urls = [f"https://h{h}.example/p{i}" for i in range(5) for h in range(3)] + ["https://h1.example/p0"]
    reader, rows = read(web, urls, interval="1.5")
    assert [p.value for p in reader.partitions()] == ["h0.example", "h1.example", "h2.example"]
    assert len(rows) == 15 and all(error is None and html == f"page {url}" for url, html, error in rows)
    for h in range(3):
        times = [t for t, url in web.asked if f"//h{h}." in url]
        assert len(times) == 6 and all(b - a >= 1.5 - 1e-9 for a, b in zip(times, times[1:]))
    assert sum(url.endswith("/robots.txt") for _, url in web.asked) == 3


def test_robots_before_a_fetch():
    web = Web()
    urls = ["http://a.example/private/x", "http://a.example/drafts/1", "http://a.example/ok", "http://a.example", "http://a.example/gone"]
    rows = {url: (html, error) for url, html, error in read(web, urls)[1]}
    assert rows["http://a.example/private/x"] == (None, "closed by robots.txt") == rows["http://a.example/drafts/1"]
    assert rows["http://a.example/ok"][0] == "page http://a.example/ok" and rows["http://a.example"][0]
    assert rows["http://a.example/gone"][1].startswith("HTTPError")
    assert not any("private" in url or "drafts" in url for _, url in web.asked)
    assert sum(url.endswith("/gone") for _, url in web.asked) == 1  # a refusal is final
    quiet = Web({"http://b.example/robots.txt", "http://b.example/down"})
    rows = read(quiet, ["http://b.example/private", "http://b.example/down"], retries="1")[1]
    assert rows[0][1] == "page http://b.example/private" and rows[1][2].startswith("URLError")
    assert sum(url.endswith("/down") for _, url in quiet.asked) == 2
    assert read(Web(), [])[1] == []


def test_rules_equal_their_column_form(spark):
    texts = [ROBOTS, "", "Disallow: /early", "USER-AGENT: *\nDISALLOW: /a:b", "User-agent: x\nDisallow: /x\nUser-agent: tally\nDisallow: /t"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", textops.robots_rules(F.col("t"), "tallyloom").alias("r"))
    assert {r.t: list(r.r) for r in frame.collect()} == {t: readers.disallowed_paths(t, "tallyloom") for t in texts}


def test_pages_through_spark(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path != "/missing"
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write((ROBOTS if self.path == "/robots.txt" else f"body {self.path}").encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        urls = spark.createDataFrame([(f"{base}/{p}",) for p in ("one", "missing", "private/z", "one")] + [(None,)], "url string")
        rows = {r.url.removeprefix(base): (r.html, r.error) for r in readers.fetch_pages(spark, urls, interval=0.01).collect()}
    finally:
        server.shutdown()
    assert rows["/one"] == ("body /one", None) and rows["/private/z"] == (None, "closed by robots.txt") and rows["/missing"][1].startswith("HTTPError")


def test_sources_that_fail_at_run_time(spark):
    columns = "id string, ord int, v int"
    make = lambda rows: lambda s: s.createDataFrame(rows, columns)
    registry = readers.Registry()
    registry.register("first", make([("a", 0, 1), ("b", 1, -1)]))
    registry.register("late", lambda s: s.createDataFrame([("a", 0, 9), ("x", 1, 9)], columns).withColumn("v", F.raise_error(F.lit("task failed")).cast("int")))
    registry.register("early", lambda s: 1 / 0)
    registry.register("last", make([("a", 0, 7), ("c", 1, 7)]))
    good, bad, failures = registry.collect(spark, [("negative", F.col("v") < 0)])
    assert {(r.id, r.v, r.origin) for r in good.collect()} == {("a", 1, "first"), ("c", 7, "last")} and [r.id for r in bad.collect()] == ["b"]
    assert [name for name, _ in failures] == ["late", "early"] and "task failed" in failures[0][1]
    assert [r.source for r in readers.failure_rows(spark, failures).collect()] == ["late", "early"]
    assert readers.failure_rows(spark, []).count() == 0
    with pytest.raises(AttributeError):
        readers.Registry().collect(spark, [])[0].count()
