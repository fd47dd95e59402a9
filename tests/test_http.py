"""The retry policy by itself, and the sources against a server on this machine."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.sources import http, tables

A = http.Answer


@pytest.mark.parametrize(
    "answer, attempt, want",
    [
        (None, 0, ("again", 2.0)), (None, 3, ("again", 8.0)), (A(200), 0, ("take", 0.0)), (A(302), 1, ("take", 0.0)), (A(404), 0, ("give up", 0.0)), (A(500), 0, ("again", 2.0)), (A(503), 2, ("again", 6.0)),
        (A(403), 1, ("again", 8.0)), (A(403, headers={"Retry-After": "7"}), 2, ("again", 7.0)), (A(403, headers={"Retry-After": "soon"}), 0, ("again", 4.0)), (A(429), 0, ("again", 4.0)),
        (A(403, headers={"x-ratelimit-remaining": "0", "X-RateLimit-Reset": "1030"}), 0, ("again", 32.0)), (A(403, headers={"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "900"}), 0, ("again", 1.0)),
        (A(403, headers={"X-RateLimit-Remaining": "5", "X-RateLimit-Reset": "1030"}), 0, ("again", 4.0)),
    ],
)
def test_policy(answer, attempt, want):
    assert http.after(answer, attempt, 1000.5) == want


def test_attempts_and_waits():
    slept, answers = [], [None, A(502), A(403, headers={"Retry-After": "3"}), A(200, b"x")]
    it = iter(answers)
    assert http.get("u", {}, 4, 1.0, lambda u, h: next(it), slept.append, lambda: 0.0) == (answers[-1], True)
    assert slept == [2.0, 4.0, 3.0]
    assert http.get("u", {}, 2, 1.0, lambda u, h: None, slept.append) == (None, False)
    assert http.get("u", {}, 2, 1.0, lambda u, h: A(404), slept.append) == (None, True)


@pytest.fixture(scope="module")
def server():
    """Pages of two repositories; each page's first request fails in a way of its own. /file/<n> has a body, /none has none, /down never answers well."""
    seen, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body=b"", **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            with lock:
                seen[self.path] += 1
                first = seen[self.path] == 1
            at = urllib.parse.urlparse(self.path)
            if at.path.startswith("/file/"):
                return self.answer(*((500,) if first and at.path.endswith("3") else (200, f"body {at.path}".encode())))
            if at.path != "/search":
                return self.answer(404 if at.path == "/none" else 503)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()}
            page = int(q["page"])
            if first and page == 1:
                return self.answer(403, X_RateLimit_Remaining="0", X_RateLimit_Reset="5")
            if first and page == 2:
                self.close_connection = True
                return self.connection.close()
            items = [{"full_name": f"{q['q']}/{page}-{k}", "stargazers_count": k, "default_branch": "main"} for k in range(2)] if page <= {"one": 1, "many": 9, "none": 0}[q["q"]] else []
            self.answer(200, json.dumps({"items": items}).encode())

        def log_message(self, *a):
            pass

        def handle_error(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.handle_error = lambda *a: None
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_paged_search_equals_landed_pages(spark, server):
    pages = http.search(spark, f"{server}/search", ["one", "many", "none"], pages=3, wait_scale=0.01)
    assert pages.rdd.getNumPartitions() == 3
    got = sorted((r["query"], r["page"], r["position"], r["full_name"], r["stargazers_count"]) for r in tables.search_results(pages).collect())
    want = [(q, p, k, f"{q}/{p}-{k}", k) for q, n in (("many", 3), ("one", 1)) for p in range(1, n + 1) for k in range(2)]
    assert got == want


def test_fetches(spark, server):
    rows = [(i, f"{server}/file/{i}") for i in range(9)] + [(100, f"{server}/none"), (101, None)]
    df = spark.createDataFrame(rows, "id int, url string")
    out = http.fetched(df, connections=3, wait_scale=0.01)
    got = {r["id"]: (r["status"], r["body"]) for r in out.collect()}
    assert out.columns == ["id", "url", "status", "body"]
    assert got == {i: (200, f"body /file/{i}") for i in range(9)} | {100: (404, None), 101: (None, None)}
    bad = spark.createDataFrame([(1, f"{server}/down")], "id int, url string")
    assert http.fetched(bad, retries=2, wait_scale=0.01, strict=False).first()["body"] is None
    with pytest.raises(Exception, match="status 503"):
        http.fetched(bad, retries=2, wait_scale=0.01).collect()
