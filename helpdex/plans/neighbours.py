"""Exact nearest neighbours of a stated query set, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpdex.functions.vectors import defect

ROW_BLOCK, QUERY_BLOCK, DECIMALS = 50_000, 4_000, 9


def cosine_neighbours(rows: DataFrame, is_query: Column, top: int, dims: int = 64) -> DataFrame:
    """(id, rank, neighbour, cosine): the ``top`` rows of the same kind most similar to each row where ``is_query`` holds.

    ``rows`` has id, kind, vec. Vectors that can't be scaled or are not ``dims`` wide take no part; repeated ids count
    once; ties (after rounding to DECIMALS) go to the smaller id.
    """
    named = rows.where(F.col("id").isNotNull() & F.col("kind").isNotNull()).select("id", "kind", "vec")
    good = named.where((F.size("vec") == dims) & defect(F.col("vec")).isNull()).dropDuplicates(["id"])
    queries = good.where(is_query)
    # upper bounds of the usable rows, counted without reading a vector
    row_blocks, query_blocks = max(1, -(-named.count() // ROW_BLOCK)), max(1, -(-named.where(is_query).count() // QUERY_BLOCK))
    placed = good.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    def scaled(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            x, y, ids, own = scaled(q["vec"]), scaled(r["vec"]), r["id"].to_numpy(), q["id"].to_numpy()
            for k in range(0, len(x), 128):
                cosine = np.round(x[k : k + 128] @ y.T, DECIMALS)
                for i, row in enumerate(cosine):
                    row[ids == own[k + i]] = -2
                    # all that tie with the last of the best stay in, so ties fall to the smaller id
                    least = np.partition(row, -top)[-top] if len(row) > top else -2
                    at = np.flatnonzero((row >= least) & (row > -2))
                    at = at[np.lexsort((ids[at], -row[at]))][:top]
                    out += [(own[k + i], ids[j], row[j]) for j in at]
        return pd.DataFrame(out, columns=["id", "neighbour", "cosine"])

    keys = ["kind", "rb", "qb"]
    found = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(run, "id bigint, neighbour bigint, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= top).select("id", "rank", "neighbour", "cosine")
