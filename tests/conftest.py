"""Session and odd data directories shared by all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYSPARK_PYTHON"] = sys.executable
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("articles", "docs", "chunks", "labelled_questions", "ask_requests", "unanswered_log", "raw_log", "documents", "eval_items", "review_labels")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", str(base / "local")).config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.checkpoint.dir", str(base / "checkpoints")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    """All tables without rows."""
    base = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """All tables with a row of nulls, empty and blank texts, a repeated row, a long text and extra columns."""
    base = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        rows = spark.read.parquet(f"{DATA}/{t}.parquet").limit(30)
        nulls = spark.createDataFrame([tuple([None] * len(rows.columns))], rows.schema)
        out = rows.unionByName(rows.limit(2)).unionByName(nulls)
        for name in ("text", "q", "question", "line"):
            if name in rows.columns:
                one = rows.limit(1)
                for value in ("''", "' '", "repeat('Ala ma kota. ', 4000)", "repeat('x', 5000)", "'漢字 ​ <|endoftext|> 👩‍👩‍👧'"):
                    out = out.unionByName(one.withColumn(name, F.expr(value)))
        extra = {c: F.lit(7) for c in ("key", "n", "unit", "rank", "score", "root", "record", "rep", "low", "item_key", "label", "features", "grade") if c not in rows.columns}
        out.withColumns(extra).coalesce(1).write.parquet(f"{base}/{t}.parquet")
    return str(base)
