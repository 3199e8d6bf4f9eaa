"""A small HTTP service over a pipeline: the routes of the reference's API, without its page.

One process serves one store; changes wait for each other, questions don't.
"""

from __future__ import annotations

import json
import queue
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from kgspark.operators import graph
from kgspark.plans.pipeline import Answer, Pipeline

#: Nodes of a page of the graph, and rows of a statement that are sent.
PAGE, ROWS = 200, 1000


class Api:
    """The routes as methods: (status, body) of each. ``events`` is the one that streams."""

    def __init__(self, pipeline: Pipeline):
        self.p, self.writing = pipeline, threading.Lock()

    def get(self, path: str, q: dict[str, str]) -> tuple[int, object]:
        store = self.p.store
        if path == "/":
            return 200, {"service": "kgspark", "routes": ["/api/graph", "/api/stats", "/api/export", "/api/pipeline/stats", "/api/pipeline/events", "/api/settings", "/api/ingest", "/api/query", "/api/cypher", "/api/chat", "/api/finalize", "/api/document"]}
        if path == "/api/stats":
            return 200, self.p.stats()
        if path == "/api/pipeline/stats":
            return 200, {"phases": self.p.telemetry.phases, "counts": self.p.telemetry.counts}
        if path == "/api/settings":
            c = self.p.config
            return 200, {"strategy": c.strategy, "chunk_size": c.chunk_size, "overlap": c.overlap, "extraction": c.extraction, "coreference": c.coreference}
        if path in ("/api/graph", "/api/export"):
            ents, edges = store.read("entities"), store.read("edges")
            if ents is None:
                return 200, {"nodes": [], "edges": []}
            if path == "/api/graph":
                if q.get("node"):  # two steps around a node
                    start = self.p.spark.createDataFrame([(q["node"].lower(),)], "name string")
                    near = graph.reachable(edges, start, 2).select(F.col("node").alias("name")).union(start).distinct()
                    ents = ents.join(near, "name", "left_semi")
                ents = ents.orderBy("name").offset(int(q.get("skip", 0))).limit(int(q.get("limit", PAGE)))
                names = ents.select("name")
                for end in ("src", "dst"):
                    edges = edges.join(names.withColumnRenamed("name", end), end, "left_semi")
            lines = lambda df: [json.loads(x) for x in df.drop("embedding").toJSON().toLocalIterator()]
            return 200, {"nodes": lines(ents), "edges": lines(edges)}
        return 404, {"error": f"no route {path}"}

    def post(self, path: str, body: dict, q: dict[str, str]) -> tuple[int, object]:
        if path == "/api/ingest":
            with self.writing:
                if body.get("text"):
                    v = self.p.ingest_text(body["text"], body.get("source", ""))
                elif body.get("path") or body.get("dir"):
                    v = self.p.ingest_folder(body.get("path") or body["dir"])
                else:
                    return 400, {"error": "text, path or dir is needed"}
            return 200, {"version": v, **self.p.stats()}
        if path == "/api/query":
            human = q.get("human", str(body.get("human", True))).lower() != "false"
            return (200, _plain(self.p.query(body["question"], human))) if body.get("question") else (400, {"error": "question is needed"})
        if path == "/api/cypher":
            rows = self.p.cypher(body.get("query") or body.get("cypher") or "", body.get("params")).limit(ROWS)
            return 200, {"columns": rows.columns, "rows": [json.loads(x) for x in rows.toJSON().collect()]}
        if path == "/api/chat":
            if not body.get("question"):
                return 400, {"error": "question is needed"}
            history = [(m.get("role", "user"), m.get("content", "")) for m in body.get("history", [])]
            return 200, _plain(self.p.chat(history, body["question"], body.get("rewrite_question", True)))
        if path == "/api/finalize":
            with self.writing:
                return 200, {"version": self.p.finalize()}
        return 404, {"error": f"no route {path}"}

    def put(self, path: str, body: dict) -> tuple[int, object]:
        if path != "/api/document":
            return 404, {"error": f"no route {path}"}
        if not body.get("source") or not body.get("text"):
            return 400, {"error": "source and text are needed"}
        with self.writing:
            return 200, {"version": self.p.update_document(body["text"], body["source"])}

    def delete(self, path: str, body: dict, q: dict[str, str]) -> tuple[int, object]:
        with self.writing:
            if path == "/api/graph":
                self.p.store.delete()
                return 200, {"deleted": True}
            if path == "/api/document":
                doc = q.get("id") or body.get("id")
                return (200, {"version": self.p.delete(doc)}) if doc else (400, {"error": "id is needed"})
        return 404, {"error": f"no route {path}"}


def _plain(a: Answer) -> dict:
    return {"answer": a.text, "entities": a.entities, "rows": a.rows, "facts": a.facts, "cypher": a.statement, "graph": {"edges": [{"from": s, "relation": r, "to": d, "weight": w} for s, r, d, w in a.graph]}}


def serve(pipeline: Pipeline, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to run: ``serve_forever()`` starts it, ``shutdown()`` ends it."""
    api = Api(pipeline)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: object) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _do(self, method: str) -> None:
            url = urlparse(self.path)
            q = {k: v[-1] for k, v in parse_qs(url.query).items()}
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size) or b"{}") if size else {}
                if method == "GET":
                    if url.path == "/api/pipeline/events":
                        return self._events()
                    out = api.get(url.path, q)
                else:
                    out = {"POST": lambda: api.post(url.path, body, q), "PUT": lambda: api.put(url.path, body), "DELETE": lambda: api.delete(url.path, body, q)}[method]()
            except (ValueError, KeyError) as e:  # what was asked is wrong
                out = 400, {"error": str(e)[:500]}
            except Exception as e:
                out = 500, {"error": f"{type(e).__name__}: {e}"[:500]}
            self._send(*out)

        def _events(self) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            q = pipeline.telemetry.subscribe()
            try:
                while True:
                    try:
                        line = "data: " + json.dumps(q.get(timeout=15), default=str)
                    except queue.Empty:
                        line = ": still here"
                    self.wfile.write((line + "\n\n").encode())
                    self.wfile.flush()
            except OSError:  # the listener has gone
                pipeline.telemetry.unsubscribe(q)

        def do_GET(self) -> None:
            self._do("GET")

        def do_POST(self) -> None:
            self._do("POST")

        def do_PUT(self) -> None:
            self._do("PUT")

        def do_DELETE(self) -> None:
            self._do("DELETE")

    return ThreadingHTTPServer((host, port), Handler)
