"""Duplicates hidden by formatting: bottom-up (Merkle) hashing of nested records.

Leaves are normalised (letters and digits only, lower case), every node's digest is made from its children's digests,
digests of unordered nodes are sorted first, and the root digest groups equal records. A group is confirmed by a full
comparison of the canonical structures, so a hash collision can never merge two records.

Defined results: a null leaf, an empty one and one without letters or digits have the same (empty) normal form; field
order, white space, case and punctuation never matter; diacritics do; records whose ``key`` leaf is empty take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpdex.plans.skew import cut, join_to_groups
from helpdex.sources.tables import table

#: What is not part of a normal form. A combining mark counts only on a letter (a decomposed diacritic).
NOISE = r"[^\p{L}\p{N}\p{M}]|(?<![\p{L}\p{M}])\p{M}|[\x{FE00}-\x{FE0F}]"

LOG_RECORD = T.StructType(
    [T.StructField("q", T.StringType()), T.StructField("top_path", T.StringType()), T.StructField("broken", T.StringType())]
)


def normal_leaf(value: Column) -> Column:
    """Letters and digits of ``value`` in lower case; an empty string for null."""
    return F.lower(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), NOISE, ""))


def canonical(value: Column, kind: T.DataType, unordered_arrays: bool = False) -> Column:
    """Canonical text of a nested value: normalised leaves, children of unordered nodes sorted, lengths in front.

    Structs and maps are unordered (their keys stay with the children); arrays are ordered unless told otherwise.
    Each child is prefixed by its length, so different structures can't have the same text.
    """
    def framed(c: Column) -> Column:
        return F.concat(F.length(c).cast("string"), F.lit(":"), c)

    if isinstance(kind, T.StructType):
        fields = [framed(F.concat(F.lit(f.name.lower() + "="), canonical(value[f.name], f.dataType, unordered_arrays))) for f in kind]
        return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array(*fields)), ""), F.lit("}"))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: framed(F.concat(normal_leaf(e["key"]), F.lit("="), canonical(e["value"], kind.valueType, unordered_arrays))))
        return F.concat(F.lit("{"), F.coalesce(F.array_join(F.array_sort(pairs), ""), F.lit("")), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: framed(canonical(x, kind.elementType, unordered_arrays)))
        items = F.array_sort(items) if unordered_arrays else items
        return F.concat(F.lit("["), F.coalesce(F.array_join(items, ""), F.lit("")), F.lit("]"))
    return normal_leaf(value)


def merkle(value: Column, kind: T.DataType, unordered_arrays: bool = False) -> Column:
    """128-bit digest (hex) of a nested value, built bottom-up from its children's digests."""
    if isinstance(kind, T.StructType):
        fields = [F.md5(F.concat(F.lit("f:" + f.name.lower() + "="), merkle(value[f.name], f.dataType, unordered_arrays))) for f in kind]
        return F.md5(F.concat(F.lit("s:"), F.array_join(F.array_sort(F.array(*fields)), "")))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.md5(F.concat(F.lit("e:"), F.md5(normal_leaf(e["key"])), merkle(e["value"], kind.valueType, unordered_arrays))))
        return F.md5(F.concat(F.lit("s:"), F.coalesce(F.array_join(F.array_sort(pairs), ""), F.lit(""))))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: merkle(x, kind.elementType, unordered_arrays))
        items = F.array_sort(items) if unordered_arrays else items
        return F.md5(F.concat(F.lit("a:"), F.coalesce(F.array_join(items, ""), F.lit(""))))
    return F.md5(F.concat(F.lit("l:"), normal_leaf(value)))


def record_groups(records: DataFrame, id_col: str, record_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: rows (id, root) and one group for each distinct record.

    ``groups`` has root, first_id (smallest id) and copies. The groups are confirmed: the smallest and the largest
    canonical structure of a root are compared in the same aggregation, and the members of a root that fails (a digest
    collision) get the digest of their canonical text added to the root. Ids that occur twice count as copies of rows,
    null ids are left out.
    """
    kind = records.schema[record_col].dataType
    rows = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), merkle(F.col(record_col), kind).alias("root"), canonical(F.col(record_col), kind).alias("canonical")
    )
    counted = rows.groupBy("root").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("canonical").alias("least"), F.max("canonical").alias("most")
    )
    groups = cut(counted.select("root", "first_id", "copies", (F.col("least") != F.col("most")).alias("collided")))
    collided = groups.where("collided")
    if not collided.isEmpty():
        apart = rows.join(collided.select("root", F.lit(True).alias("hit")), "root", "left")
        rows = apart.select("id", F.when(F.col("hit"), F.concat("root", F.sha2("canonical", 256))).otherwise(F.col("root")).alias("root"))
        groups = cut(rows.groupBy("root").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    return rows.select("id", "root"), groups.select("root", "first_id", "copies")


def log_records(spark, data_dir: str) -> dict[str, DataFrame]:
    """(id, record) of both logs; entries whose q has no letter or digit and lines that are not JSON are left out."""
    entries = table(spark, data_dir, "unanswered_log").select(F.col("entry_id").alias("id"), F.struct("q", "top_path").alias("record"))
    lines = table(spark, data_dir, "raw_log").select(
        F.col("line_id").alias("id"),
        F.from_json("line", LOG_RECORD, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}).alias("parsed"),
    )
    parsed = lines.where(F.col("parsed.broken").isNull()).select("id", F.struct("parsed.q", "parsed.top_path").alias("record"))
    return {
        "unanswered_log": entries.where(F.col("record.q").rlike(r"[\p{L}\p{N}]")),
        "raw_log": parsed.where(F.col("record.q").rlike(r"[\p{L}\p{N}]")),
    }


def p2_records(spark, data_dir: str) -> DataFrame:
    """One row for each distinct record of each log with the number of its copies."""
    out = None
    for name, records in log_records(spark, data_dir).items():
        groups = record_groups(records, "id", "record")[1].select(F.lit(name).alias("item_table"), "first_id", "copies")
        out = groups if out is None else out.unionByName(groups)
    return out


def p2_found(spark, data_dir: str) -> DataFrame:
    """One row for each entry that is not the smallest id of its record (see TESTDATA.md)."""
    out = None
    for name, records in log_records(spark, data_dir).items():
        rows, groups = record_groups(records, "id", "record")
        repeated = groups.where("copies > 1")
        found = (
            join_to_groups(rows, repeated, "root", "copies")
            .where("id != first_id")
            .select(F.lit(name).alias("item_table"), "first_id", F.col("id").alias("copy_id"))
        )
        out = found if out is None else out.unionByName(found)
    return out


_KEYS = r"""
    SELECT item_table, id,
           lower(regexp_replace(q, '[^\p{L}\p{N}\p{M}]|[\x{FE00}-\x{FE0F}]', '', 'g')) AS nq,
           lower(regexp_replace(coalesce(top_path, ''), '[^\p{L}\p{N}\p{M}]|[\x{FE00}-\x{FE0F}]', '', 'g')) AS np
    FROM (
        SELECT 'unanswered_log' AS item_table, entry_id AS id, q, top_path FROM unanswered_log
        UNION ALL
        SELECT 'raw_log', line_id, json_extract_string(line, '$.q'), json_extract_string(line, '$.top_path')
        FROM (SELECT * FROM raw_log WHERE json_valid(line))
    )
    WHERE regexp_matches(q, '[\p{L}\p{N}]')
"""

SQL = {
    "p2_found": f"""
        SELECT item_table, first_id, id AS copy_id
        FROM (SELECT *, min(id) OVER (PARTITION BY item_table, nq, np) AS first_id FROM ({_KEYS}))
        WHERE id <> first_id
    """,
    "p2_records": f"""
        SELECT item_table, min(id) AS first_id, count(*) AS copies FROM ({_KEYS}) GROUP BY item_table, nq, np
    """,
}
QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
