"""Building and updating a stored index from a directory of articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdex.functions.text import or_empty, title_of
from helpdex.operators import sync
from helpdex.operators.chunking import entries
from helpdex.operators.embedding import Embedder
from helpdex.plans.skew import cut
from helpdex.sources.articles import readable, scan, skipped
from helpdex.sources.config import Config
from helpdex.sources.snapshot import CHUNKS, DOCS, Store, fingerprint


@dataclass(frozen=True)
class IndexStats:
    indexed: int
    unchanged: int
    deleted: int
    chunks: int
    skipped: int


def described(articles: DataFrame) -> DataFrame:
    """(path, text, hash, title, url, questions, keywords) of (path, text, hash, meta) articles; meta may be null."""
    return articles.select("path", "text", "hash", title_of(F.col("meta.title"), F.col("path")).alias("title"), or_empty(F.col("meta.source_url")).alias("url"), F.col("meta.questions").alias("questions"), F.col("meta.keywords").alias("keywords"))


def index_print(config: Config) -> str:
    e = config.embedding
    return fingerprint(model=e.model, dims=e.dims, doc_prefix=e.doc_prefix, query_prefix=e.query_prefix, chunk_chars=config.chunk_chars)


def build_index(spark: SparkSession, config: Config, embedder: Embedder) -> tuple[IndexStats, DataFrame]:
    """Bring the stored index up to date; returns what was done and the skipped files (path, reason).

    Only new and changed articles are embedded. Another fingerprint rebuilds everything; the old snapshot stays current
    until the new one is complete. Articles without text are skipped and keep what is stored for them.
    """
    store, print_ = Store(spark, config.db_path), index_print(config)
    scanned = cut(scan(spark, config.docs_dir))
    current = described(readable(scanned))
    old = store.manifest()
    docs, chunks = store.read() if old and old.fingerprint == print_ else (spark.createDataFrame([], DOCS), spark.createDataFrame([], CHUNKS))
    failed = skipped(scanned)
    planned = cut(sync.actions(current, docs, failed))
    todo = current.join(planned.where(F.col("action").isin(sync.INSERT, sync.UPDATE)).select("path"), "path", "left_semi")
    listed = entries(todo, config.chunk_chars, config.embedding.doc_prefix, config.embedding.query_prefix)
    fresh = cut(embedder.embed(listed, "embed_text").select("path", F.col("ord").cast("int").alias("ord"), "kind", "text", "vec"))
    new_docs = todo.join(fresh.select("path").distinct(), "path", "left_semi").select("path", "hash", "title", "url")
    empty = todo.join(fresh.select("path").distinct(), "path", "left_anti").select("path", F.lit("no text").alias("reason"))
    store.write(sync.merged(docs, planned, new_docs), sync.merged(chunks, planned, fresh), print_)
    counted = sync.stats(planned).first()
    without_text = empty.count()
    stats = IndexStats(counted["indexed"] - without_text, counted["unchanged"], counted["deleted"], fresh.count(), failed.count() + without_text)
    return stats, failed.unionByName(empty)
