"""Incremental synchronisation of an index with its articles, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, UNCHANGED, DELETE, KEEP = "insert", "update", "unchanged", "delete", "keep"


def latest(articles: DataFrame) -> DataFrame:
    """One row for each path of the readings (path, hash, title, url, read_at): the last reading, then the largest hash.

    Only short columns go through the shuffle, and partial aggregation keeps one candidate of a path per task.
    """
    last = F.max_by(F.struct("hash", "title", "url"), F.struct("read_at", "hash"))
    return articles.where(F.col("path").isNotNull()).groupBy("path").agg(last.alias("d")).select("path", "d.hash", "d.title", "d.url")


def actions(current: DataFrame, stored: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(path, action) of every path in the articles (path, hash) or the index (path, hash).

    A stored path that is gone is deleted, unless it is among the ``unreadable`` (path) files, whose entries are kept.
    Both sides must have one row a path.
    """
    new, old = current.select("path", F.col("hash").alias("new")), stored.select("path", F.col("hash").alias("old"))
    gone = F.lit(DELETE)
    joined = new.join(old, "path", "full_outer")
    if unreadable is not None:
        joined = joined.join(unreadable.select("path", F.lit(True).alias("failed")).distinct(), "path", "left")
        gone = F.when(F.col("failed"), KEEP).otherwise(DELETE)
    return joined.select("path", F.when(F.col("old").isNull(), INSERT).when(F.col("new").isNull(), gone).when(F.col("new") == F.col("old"), UNCHANGED).otherwise(UPDATE).alias("action"))


def stats(planned: DataFrame) -> DataFrame:
    """One row: indexed (inserted or updated), unchanged, deleted."""
    return planned.agg(F.count_if(F.col("action").isin(INSERT, UPDATE)).alias("indexed"), F.count_if(F.col("action") == UNCHANGED).alias("unchanged"), F.count_if(F.col("action") == DELETE).alias("deleted"))


def merged(stored: DataFrame, planned: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` rows (docs or chunks) that stay, and the ``fresh`` rows of inserted and updated paths.

    An updated path without fresh rows (its text has become empty) keeps its stored ones.
    """
    written = fresh.select("path").distinct()
    replaced = planned.where(F.col("action").isin(INSERT, UPDATE)).join(written, "path", "left_semi").select("path")
    dropped = planned.where(F.col("action") == DELETE).select("path").unionByName(replaced)
    return stored.select(*fresh.columns).join(dropped, "path", "left_anti").unionByName(fresh.join(replaced, "path", "left_semi"))
