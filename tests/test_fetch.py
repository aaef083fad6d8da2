"""Fetching against a server of this machine: bodies, redirects, statuses, failures as rows."""

import hashlib
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexgrid.sources.fetch import complaint, fetch, fetched

BODY = b"%PDF-1.7 " + bytes(range(256)) * 600


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/doc")
            self.end_headers()
            return
        self.send_response({"/doc": 200, "/gone": 410}.get(self.path, 500))
        self.end_headers()
        self.wfile.write(BODY if self.path == "/doc" else b"no")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_one_source(server):
    got = fetch(f"{server}/moved")
    assert (got.http_status, got.redirected, got.resolved_url, got.content) == (200, True, f"{server}/doc", BODY)
    assert got.content_hash == hashlib.sha256(BODY).hexdigest()
    assert fetch(f"{server}/doc", most=100).error == "more than 100 bytes"
    assert fetch("file:///etc/hostname").error == "not a web address"


def test_bodies():
    assert complaint(BODY, "pdf") is None and complaint(b"<p>", "html") is None
    assert "login" in complaint(b"<h1>Please SIGN IN</h1>", "pdf") and complaint(b"", "pdf") == "not a document"


def test_failures_are_rows(spark, server):
    urls = [f"{server}/doc", f"{server}/doc", f"{server}/gone", f"{server}/broken", "http://127.0.0.1:9/", "nonsense", None]
    found = {r["url"]: r for r in fetched(spark.createDataFrame([(u,) for u in urls], "u string"), "u", tasks=2).collect()}
    assert len(found) == 5
    assert found[f"{server}/doc"]["content"] == BODY
    assert [found[f"{server}/{p}"]["http_status"] for p in ("doc", "gone", "broken")] == [200, 410, 500]
    assert found["http://127.0.0.1:9/"]["error"] and found["nonsense"]["error"] == "not a web address"
    assert fetched(spark.createDataFrame([], "u string"), "u").count() == 0
