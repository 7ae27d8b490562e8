import json
import pickle
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from dossierkit.functions.embed import embed_column
from dossierkit.functions.embed_http import HttpEmbedder
from dossierkit.sources.records import SCANS
from dossierkit.sources.server import RecordServer, fetch

DOCS = [{"id": f"{c}{i}", "ddmudate": [f"2020-0{i}-01"], "ti": "x"} for c in "agp" for i in range(1, 6)]


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _send(self, body, code=200):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path.startswith("/bad"):
            return self._send(b"oops", 500)
        if self.path.startswith("/text"):
            return self._send(b"no json")
        q = parse_qs(urlparse(self.path).query)
        rows = list(DOCS)
        for f in q.get("fq", []):
            name, _, span = f.partition(":")
            low, _, high = span[1:-1].partition(" TO ")
            value = (lambda d: max(d["ddmudate"])) if name == "ddmudate" else (lambda d: d["id"])
            rows = [d for d in rows if (low == "*" or value(d) >= low) and (high == "*" or (value(d) < high if span[-1] == "}" else value(d) <= high))]
        at = 0 if q["cursorMark"] == ["*"] else int(q["cursorMark"][0])
        size = int(q["rows"][0])
        page = rows[at : at + size]
        keep = q.get("fl", [""])[0].split(",") if "fl" in q else None
        page = [{k: v for k, v in d.items() if keep is None or k in keep} for d in page]
        self._send({"response": {"docs": page, "numFound": len(rows)}, "nextCursorMark": str(at + len(page)) if page else q["cursorMark"][0]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
        if "few" in body["input"]:
            data = data[:-1]
        self._send({"data": data[::-1]})


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_cursor_pages(spark, server):
    spark.dataSource.register(RecordServer)
    read = lambda **o: spark.read.format("record_server").options(url=f"{server}/select", pageSize="2", **o).load()
    assert {r["id"] for r in read().collect()} == {d["id"] for d in DOCS}
    sliced = read(slices="g,p")
    assert sliced.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in sliced.collect()) == sorted(d["id"] for d in DOCS)
    late = read(since="2020-05-01", fields="ddmudate").collect()
    assert {r["id"] for r in late} == {"a5", "g5", "p5"} and all("ti" not in json.loads(r["record"]) for r in late)


def test_scans_by_kind(spark, server):
    spark.dataSource.register(RecordServer)
    docs = [json.loads(r["record"]) for r in spark.read.format("record_server").options(url=f"{server}/select", scan="light").load().collect()]
    assert len(docs) == len(DOCS) and all(set(d) == {"id", "ddmudate"} for d in docs)
    assert SCANS["classify"] == ["artifact", "deaccessioned", "published"] and "ot" not in SCANS["lean"] and {"ti", "filename", "artifact", "published"} <= set(SCANS["lean"])
    lean = [json.loads(r["record"]) for r in spark.read.format("record_server").options(url=f"{server}/select").load().collect()]
    assert all("ti" in d for d in lean)


def test_failures_name_their_cause(server):
    for path, cause in (("/bad", "HTTP 500"), ("/text", "no JSON")):
        with pytest.raises(RuntimeError, match=cause):
            fetch(server + path, {})
    with pytest.raises(RuntimeError):
        fetch("http://127.0.0.1:9", {})


def test_embedding(spark, server):
    e = HttpEmbedder(f"{server}, {server}/", "m")
    assert e.embed(["abc", "z"]).tolist() == [[3.0, 1.0], [1.0, 1.0]]
    with pytest.raises(RuntimeError, match="1 vectors for 2"):
        e.embed(["few", "x"])
    with pytest.raises(ValueError):
        HttpEmbedder(" , ", "m")
    assert [e._take() for _ in range(4)].count(0) == 2
    got = embed_column(spark.createDataFrame([("ab",), (None,)], "t string"), "t", pickle.loads(pickle.dumps(e))).collect()
    assert sorted(r["vector"][0] for r in got) == [0.0, 2.0]
