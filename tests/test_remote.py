"""The HTTP data source against a local service that fails now and then."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from textloom.sources import remote


class Service(ThreadingHTTPServer):
    def __init__(self) -> None:
        super().__init__(("127.0.0.1", 0), Handler)
        self.rows = [{"id": i, "term": f"t{i}"} for i in range(95)]
        self.staged, self.committed, self.aborted, self.asked, self.times = {}, {}, [], [], []
        self.fail_every, self.refuse, self.lock = 0, None, threading.Lock()

    def answer(self, body: dict) -> tuple[int, dict]:
        with self.lock:
            self.asked.append(body)
            self.times.append(time.monotonic())
            if "read" in body:
                if self.fail_every and len(self.asked) % self.fail_every == 0:
                    return 503, {}
                page, size = body["read"]["page"], body["read"]["size"]
                return 200, {"rows": self.rows[page * size : (page + 1) * size]}
            if "stage" in body:
                s = body["stage"]
                if self.refuse is not None and any(r["id"] == self.refuse for r in s["rows"]):
                    return 400, {}
                self.staged[s["job"], s["partition"], s["batch"]] = s["rows"]  # one for each name, however often it is sent
                return (503, {}) if self.fail_every and len(self.asked) % self.fail_every == 0 else (200, {})
            if "commit" in body:
                job = body["commit"]["job"]
                self.committed[job] = [r for k in sorted(self.staged) if k[0] == job for r in self.staged[k]]
                return 200, {}
            self.aborted.append(body["abort"]["job"])
            return 200, {}


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def do_POST(self):  # noqa: N802
        status, out = self.server.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        data = json.dumps(out).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service(spark):
    remote.register(spark)
    server = Service()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def url(service):
    return f"http://127.0.0.1:{service.server_address[1]}/"


@pytest.mark.parametrize("fail_every", [0, 4])
@pytest.mark.parametrize("rows", [0, 95, 100])
def test_read(spark, service, rows, fail_every):
    service.fail_every = fail_every
    service.rows = [{"id": i, "term": f"t{i}"} for i in range(rows)]
    df = spark.read.format("textloom_http").schema("id long, term string, missing string").options(url=url(service), partitions=3, size=10, delay=0.01, attempts=12).load()
    assert df.rdd.getNumPartitions() == 3
    service.asked.clear()
    assert sorted((r.id, r.term, r.missing) for r in df.collect()) == [(i, f"t{i}", None) for i in range(rows)]
    pages = [b["read"]["page"] for b in service.asked]
    assert fail_every or len(pages) == len(set(pages))


@pytest.mark.parametrize("fail_every", [0, 3])
def test_write(spark, service, fail_every):
    """Rows are seen once each after the commit, though some batches were sent twice."""
    service.fail_every = fail_every
    df = spark.range(230).selectExpr("id", "concat('t', id) AS term", "timestamp '2024-01-01' AS at").repartition(4)
    df.write.format("textloom_http").mode("append").options(url=url(service), size=20, delay=0.01, attempts=12, job="one").save()
    assert sorted(r["id"] for r in service.committed["one"]) == list(range(230)) and service.aborted == []
    sent = [(b["stage"]["partition"], b["stage"]["batch"]) for b in service.asked if "stage" in b]
    assert (len(sent) > len(set(sent))) == bool(fail_every)


def test_abort(spark, service):
    service.refuse = 57
    with pytest.raises(Exception, match="status 400"):
        spark.range(100).repartition(3).write.format("textloom_http").mode("append").options(url=url(service), size=10, delay=0.01, job="two").save()
    assert service.committed == {} and service.aborted == ["two"]


def test_rate(spark, service):
    df = spark.read.format("textloom_http").schema("id long").options(url=url(service), partitions=1, size=10, rate=50).load()
    service.times.clear()
    assert df.count() == 95
    assert all(b - a >= 0.015 for a, b in zip(service.times, service.times[1:]))
