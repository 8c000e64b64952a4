"""A small HTTP service over one Spark session: POST /ask and GET /healthz."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from helpdex.operators.answering import Chatter, ask
from helpdex.operators.embedding import Embedder
from helpdex.sources.config import Config
from helpdex.sources.questions import append_unanswered
from helpdex.sources.snapshot import Store

MOST_BYTES = 64 * 1024


class Engine:
    """The current snapshot, cached, and the answering of single questions against it."""

    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder, chatter: Chatter | None = None):
        self.spark, self.config, self.embedder, self.chatter = spark, config, embedder, chatter
        self.store, self.lock = Store(spark, config.db_path), threading.Lock()
        self.tables: tuple[DataFrame, DataFrame] | None = None
        self.reload()

    def reload(self) -> None:
        """Switch to the newest snapshot; on any failure the old one stays. An empty index is an error."""
        manifest = self.store.manifest()
        if manifest is None or manifest.chunks == 0:
            raise RuntimeError("the index is empty: build it first")
        docs, chunks = (t.cache() for t in self.store.read())
        with self.lock:
            old, self.tables, self.chunks = self.tables, (docs, chunks), manifest.chunks
        for t in old or ():
            t.unpersist()

    def ask(self, question: str) -> dict:
        with self.lock:
            docs, chunks = self.tables
        asked = self.spark.createDataFrame([(1, question)], "qid bigint, question string")
        answers = ask(asked, chunks, docs, self.config, self.embedder, self.chatter).cache()
        try:
            row = answers.first()
            if row["error"]:
                raise RuntimeError(row["error"])
            if not row["answered"] and self.config.unanswered_log:
                append_unanswered(answers, self.config.unanswered_log)
        finally:
            answers.unpersist()
        out = {"answered": row["answered"], "answer": row["answer"], "top_score": row["top_score"], "sources": [{k: v for k, v in s.asDict().items() if v != "" or k not in ("title", "url")} for s in row["sources"]]}
        return out | ({"reason": row["reason"]} if row["reason"] else {})


def server(engine: Engine) -> ThreadingHTTPServer:
    """The service, bound to the configured address; call ``serve_forever`` and ``shutdown`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False, indent=2).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/healthz":
                self.reply(200, {"status": "ok", "chunks": engine.chunks})
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/ask":
                return self.reply(404, {"error": "not found"})
            size = int(self.headers.get("Content-Length") or 0)
            try:
                if size > MOST_BYTES:
                    raise ValueError("body too large")
                question = json.loads(self.rfile.read(size))["question"]
                if not isinstance(question, str) or not question.strip():
                    raise ValueError("question is empty")
            except (ValueError, KeyError, TypeError) as e:
                return self.reply(400, {"error": str(e)})
            try:
                self.reply(200, engine.ask(question))
            except Exception as e:
                self.reply(502, {"error": str(e)[:300]})

        def log_message(self, *_: object) -> None:
            pass

    host, _, port = engine.config.server.addr.rpartition(":")
    return ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
