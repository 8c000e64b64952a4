"""Joins and checkpoints that hold when one key owns a large share of the rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one in HEAVY_SHARE rows, so there are fewer than HEAVY_SHARE heavy keys
#: whatever the size of the data. That is the proven bound which allows a broadcast of them.
HEAVY_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the checkpoint folder the cluster names; set a temporary one only where none is named (tests, laptops)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helpdex-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: survives the loss of executors."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, where ``groups`` has one row for each key and ``count`` rows of that key.

    Rows of heavy keys meet their group through a broadcast (fewer than HEAVY_SHARE groups by the pigeonhole
    principle), so they are never shuffled to one task; all other rows take an ordinary equi-join on the key.
    ``groups`` is read three times: pass a checkpointed frame. Null keys match nothing, as in any equi-join.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    heavy = groups.where((F.col(count) * HEAVY_SHARE > F.lit(total)) & (F.col(count) > 1))
    light = groups.where(~((F.col(count) * HEAVY_SHARE > F.lit(total)) & (F.col(count) > 1)))
    heavy_keys = heavy.select(key)
    ordinary = rows.join(F.broadcast(heavy_keys), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy), key).unionByName(ordinary)
