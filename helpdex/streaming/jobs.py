"""Streaming jobs: questions answered as they arrive, the unanswered log watched, the index kept fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helpdex.operators.answering import Chatter, ask
from helpdex.operators.embedding import Embedder
from helpdex.sources.config import Config


def answer_stream(requests: DataFrame, snapshot: Callable[[], tuple[DataFrame, DataFrame]], config: Config, embedder: Embedder, sink: Callable[[DataFrame, int], None], checkpoint: str, chatter: Chatter | None = None) -> StreamingQuery:
    """Answer a stream of (qid, question) rows, batch by batch, against the snapshot current at each batch.

    ``snapshot`` returns (docs, chunks) and is asked for every batch, so a new index takes effect without a restart.
    """

    def each(batch: DataFrame, number: int) -> None:
        docs, chunks = snapshot()
        sink(ask(batch, chunks, docs, config, embedder, chatter), number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_redeliveries(requests: DataFrame, delay: str = "6 days") -> DataFrame:
    """Requests once each: a request_id that comes again within ``delay`` of its reception is dropped.

    Works on streams (state is bounded by the watermark) and, with the same result for times within it, on tables.
    """
    kept = requests.where(F.col("request_id").isNotNull())
    if requests.isStreaming:
        return kept.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["request_id"])
    return kept.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in requests.columns if c != "request_id"]), F.struct("stored_at")).alias("r")).select("request_id", "r.*")


def reasons_by_window(log: DataFrame, width: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(start, reason, entries) of tumbling windows of the log's time; late entries count up to ``lateness`` on streams."""
    timed = log.withWatermark("time", lateness) if log.isStreaming else log
    return timed.groupBy(F.window("time", width).alias("w"), "reason").agg(F.count(F.lit(1)).alias("entries")).select(F.col("w.start").alias("start"), "reason", "entries")
