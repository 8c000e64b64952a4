"""Labelled questions and the log of unanswered ones, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "q string, relevant array<string>, broken string"
LOGGED = "time timestamp, q string, reason string, top_score double, top_path string, broken string"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(q, relevant); blank lines are skipped, a missing list is empty, a broken line or a blank q is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", LABELLED, {"columnNameOfCorruptRecord": "broken"}).alias("r"))
    bad = F.col("r.broken").isNotNull() | F.col("r.q").isNull() | (F.trim("r.q") == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad question line: "), F.substring("value", 1, 200)))).otherwise(F.col("r.q"))
    return parsed.select(checked.cast("string").alias("q"), F.coalesce("r.relevant", F.array().cast("array<string>")).alias("relevant"))


def parsed_log(lines: DataFrame) -> DataFrame:
    """(line_id, time, q, reason, top_score, top_path, ok) of (line_id, line) rows; ok is false for lines that are not JSON."""
    parsed = lines.select("line_id", F.from_json("line", LOGGED, {"columnNameOfCorruptRecord": "broken"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r.broken").isNull()
    kept = [F.when(ok, F.col(f"r.{c}")).alias(c) for c in ("time", "q", "reason", "top_score", "top_path")]
    return parsed.select("line_id", *kept, ok.alias("ok"))


def append_unanswered(answers: DataFrame, path: str) -> None:
    """Append the unanswered of ``answers`` to a folder of JSON lines; an empty top_path is left out of its line."""
    rows = answers.where(~F.col("answered") & F.col("error").isNull())
    rows.select(F.current_timestamp().alias("time"), F.col("question").alias("q"), "reason", "top_score", F.nullif("top_path", F.lit("")).alias("top_path")).write.mode("append").option("ignoreNullFields", True).json(path)
