"""Exact retrieval: every question against every entry, in blocks, then documents ranked by their best entry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpdex.operators.chunking import TEXT

TOP_K, BODY_PARTS = 5, 3
#: Entries and questions that meet in one task.
ENTRY_BLOCK, QUESTION_BLOCK = 20_000, 2_000
#: Blocks whose results are merged first.
BAND = 256
#: Decimals of a score: equal texts must tie whatever the order of summation.
DECIMALS = 9

HITS = "qid bigint, path string, score double, band bigint, parts array<struct<score: double, ord: int, text: string>>"


def _block_ranks(questions: pd.DataFrame, entries: pd.DataFrame, top_k: int) -> pd.DataFrame:
    """The best documents of one block for each question, with the best body texts of each (also of all large documents)."""
    out: list[tuple] = []
    if len(questions) and len(entries):
        band = int(entries["eb"].iloc[0]) // BAND if "eb" in entries else 0
        entries = entries.sort_values(["path", "ord"], kind="stable")
        x = np.stack(entries["vec"].to_numpy()).astype(np.float64)
        path, ord_, text = entries["path"].to_numpy(), entries["ord"].to_numpy(), entries["text"].to_numpy()
        is_text, large = (entries["kind"] == TEXT).to_numpy(), entries["large"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        ends = np.append(starts[1:], len(path))
        q = np.stack(questions["qvec"].to_numpy()).astype(np.float64)
        for k in range(0, len(q), 256):
            scores = np.round(q[k : k + 256] @ x.T, DECIMALS)
            for i, row in enumerate(scores):
                best = np.maximum.reduceat(row, starts)
                order = np.lexsort((np.arange(len(best)), -best))[:top_k]
                for d in np.union1d(order, np.flatnonzero(large[starts])):
                    at = np.arange(starts[d], ends[d])
                    at = at[is_text[at]]
                    at = at[np.lexsort((ord_[at], -row[at]))][:BODY_PARTS]
                    out.append((questions["qid"].iloc[k + i], path[starts[d]], float(best[d]), band, [(float(row[j]), int(ord_[j]), text[j]) for j in at]))
    return pd.DataFrame(out, columns=["qid", "path", "score", "band", "parts"])


def retrieve(questions: DataFrame, entries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(qid, rank, path, score, text): the ``top_k`` documents of each (qid, qvec) question.

    ``entries`` has path, ord, kind, text, vec. A document's score is its best entry's; its text is made of its three
    best body entries in their order. Ties go to the smaller path, then ord. Vectors of another width than the
    question's and nulls take no part. A document with a large share of the entries is spread over blocks.
    """
    width = F.size("vec")
    usable = entries.select("path", "ord", "kind", "text", "vec").where(F.col("vec").isNotNull() & F.col("path").isNotNull())
    asked = questions.select("qid", "qvec").where(F.col("qid").isNotNull() & F.col("qvec").isNotNull())
    # counted without the vectors, so that entries embedded on the way are not embedded for it
    sizes = entries.where(F.col("path").isNotNull()).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    half = max(1, ENTRY_BLOCK // 2)
    large = sizes.where(F.col("n") > half).select("path", F.ceil(F.col("n") / half).alias("slices"))
    blocks, question_blocks = max(1, -(-total // ENTRY_BLOCK)), max(1, -(-questions.where(F.col("qid").isNotNull()).select("qid").count() // QUESTION_BLOCK))
    # a large document takes as many blocks as it fills
    slice_ = F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("ord", "kind", "text"), F.col("slices"))).otherwise(F.lit(0))
    placed = (
        usable.join(large, "path", "left")
        .withColumn("large", F.col("slices").isNotNull())
        .withColumn("eb", F.pmod(F.pmod(F.xxhash64("path"), F.lit(blocks)) + slice_, F.lit(blocks)).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(question_blocks - 1))))
        .withColumn("width", width)
    )
    spread = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(question_blocks)).cast("int")).withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("width", F.size("qvec"))
    keys = ["eb", "qb", "width"]
    ranked = spread.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(lambda q, e: _block_ranks(q, e, top_k), HITS)

    def best_parts(parts: Column) -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list(parts)), asc=True), 1, BODY_PARTS)

    # in two steps, so that no list grows with the number of blocks
    turned = ranked.withColumn("parts", F.transform("parts", lambda p: F.struct((-p["score"]).alias("s"), p["ord"].alias("ord"), p["text"].alias("text"))))
    bands = turned.groupBy("qid", "path", "band").agg(F.max("score").alias("score"), best_parts(F.col("parts")).alias("parts"))
    docs = bands.groupBy("qid", "path").agg(F.max("score").alias("score"), best_parts(F.col("parts")).alias("parts"))
    top = docs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= top_k)
    best = F.transform("parts", lambda p: F.struct(p["ord"].alias("ord"), p["text"].alias("text")))
    body = F.array_join(F.transform(F.array_sort(best), lambda p: p["text"]), "\n\n")
    return top.select("qid", "rank", "path", "score", body.alias("text"))


def with_document(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with title and url of their documents, empty where a document is not known."""
    known = docs.select("path", "title", "url").dropDuplicates(["path"])
    return hits.join(known, "path", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "url")})


def relevant(hits: DataFrame, min_score: float, max_gap: float) -> DataFrame:
    """Hits of at least ``min_score`` that are at most ``max_gap`` below the question's best (0 switches that off)."""
    kept = hits.where(F.col("score") >= min_score)
    if max_gap <= 0:
        return kept
    best = F.max("score").over(Window.partitionBy("qid"))
    return hits.withColumn("best", best).where((F.col("score") >= min_score) & (F.col("score") >= F.col("best") - F.lit(max_gap))).drop("best")
