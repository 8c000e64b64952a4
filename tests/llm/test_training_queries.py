"""Every query of the subpackage against its SQL, and on empty and odd tables."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA, TABLES
from helpdex.llm.personal_data import question_items
from helpdex.llm.registry import QUERIES, SQL
from test_catalogue import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES, SQL, name, DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd_dir, name):
    QUERIES[name](spark, odd_dir).collect()


@pytest.fixture(scope="module")
def null_keys_dir(spark, tmp_path_factory):
    """Tables whose every second key is null, and some whose texts share a key."""
    base = tmp_path_factory.mktemp("nulls")
    keys = {"articles": "path", "chunks": "id", "ask_requests": "request_id", "unanswered_log": "entry_id"}
    for t in TABLES:
        if (key := keys.get(t)) is None:
            (base / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
            continue
        rows = spark.read.parquet(f"{DATA}/{t}.parquet")
        shared = rows.agg(F.min(key)).first()[0]
        place = F.pmod(F.xxhash64(key), F.lit(4))
        rows.withColumn(key, F.when(place < 2, None).when(place == 2, F.lit(shared)).otherwise(F.col(key))).coalesce(1).write.parquet(f"{base}/{t}.parquet")
    return str(base)


def test_found_texts_of_null_and_shared_keys(spark, null_keys_dir):
    compare(spark, QUERIES, SQL, "p3_found", null_keys_dir)


def test_joined_texts_of_null_and_shared_keys(spark, null_keys_dir):
    compare(spark, QUERIES, SQL, "p3_joined", null_keys_dir)


def test_pieces_of_null_and_shared_keys(spark, null_keys_dir):
    starts = QUERIES["p3_pieces"](spark, null_keys_dir).where("piece = 0")
    whole = QUERIES["p3_joined"](spark, null_keys_dir)
    by_key = lambda df: {(r["item_table"], r["item_key"]): r["count"] for r in df.groupBy("item_table", "item_key").count().collect()}
    assert by_key(starts) == by_key(whole) and by_key(starts)["chunks", None] > 1


def test_redacted_texts_of_null_and_shared_ids(spark, null_keys_dir):
    by_id = lambda df: {(r["item_table"], r["item_id"]): r["count"] for r in df.groupBy("item_table", "item_id").count().collect()}
    asked = by_id(question_items(spark, null_keys_dir).distinct())
    assert by_id(QUERIES["p5_redacted"](spark, null_keys_dir)) == asked and asked["ask_requests", None] > 1
