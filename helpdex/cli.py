"""Commands: index, ask, serve, calibrate."""

from __future__ import annotations

import argparse
import json
import signal
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helpdex.operators.answering import HttpChatter
from helpdex.operators.calibration import measure, suggest
from helpdex.operators.embedding import Embedder, HashingEmbedder, HttpEmbedder, checked_batch_size
from helpdex.operators.indexing import build_index
from helpdex.serving import Engine, server
from helpdex.sources.config import Config, load
from helpdex.sources.questions import read_labelled
from helpdex.sources.snapshot import Store


def embedder_of(config: Config, offline: bool) -> Embedder:
    e = config.embedding
    if offline:
        return HashingEmbedder()
    return checked_batch_size(HttpEmbedder(e.base_url, e.model, e.dims, e.batch_size, e.timeout_sec, e.api_key), "first probe", "second probe, longer")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="helpdex", description=__doc__)
    parser.add_argument("--config", help="YAML file; config.yaml is used if it exists")
    parser.add_argument("--offline", action="store_true", help="hashing embedder and fragments instead of models")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index", help="bring the index up to date")
    commands.add_parser("ask", help="answer one question").add_argument("question", nargs="+")
    commands.add_parser("serve", help="answer over HTTP")
    commands.add_parser("calibrate", help="suggest a threshold").add_argument("questions", help="JSON lines with q and relevant")
    args = parser.parse_args(argv)
    config = load(args.config)
    spark = SparkSession.builder.appName("helpdex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    embedder = embedder_of(config, args.offline)
    if args.command == "index":
        stats, skipped = build_index(spark, config, embedder)
        print(f"indexed {stats.indexed}, unchanged {stats.unchanged}, deleted {stats.deleted}, chunks {stats.chunks}, skipped {stats.skipped}")
        for row in skipped.orderBy("path").toLocalIterator():
            print(f"skipped {row['path']}: {row['reason']}", file=sys.stderr)
        return 0
    if args.command == "calibrate":
        docs, chunks = Store(spark, config.db_path).read()
        asked = read_labelled(spark, args.questions).withColumn("qid", F.monotonically_increasing_id()).withColumn("query", F.concat(F.lit(config.embedding.query_prefix), "q"))
        questions = embedder.embed(asked, "query").withColumnRenamed("vec", "qvec").cache()
        measured = measure(questions, chunks).cache()
        measured.join(questions.select("qid", "q"), "qid").orderBy(F.desc("top_score"), "q").select("top_score", "hit", "in_base", "top_path", "q").show(1000, truncate=False)
        best = suggest(measured).first()
        if best is None:
            print("calibration needs questions with and without an answer in the base", file=sys.stderr)
            return 1
        print(f"min_score now {config.search.min_score:.3f}, suggested {best['value']:.3f} ({best['correct']} of {best['total']} right)")
        return 0
    a = config.answer
    chatter = None if args.offline or a.mode == "fragments" else HttpChatter(a.base_url, a.model, a.temperature, a.timeout_sec, a.api_key)
    engine = Engine(spark, config, embedder, chatter)
    if args.command == "ask":
        print(json.dumps(engine.ask(" ".join(args.question)), ensure_ascii=False, indent=2))
        return 0
    service = server(engine)
    signal.signal(signal.SIGHUP, lambda *_: engine.reload())
    signal.signal(signal.SIGTERM, lambda *_: service.server_close())
    service.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
