"""Measuring retrieval on labelled questions and suggesting the score threshold that parts them best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpdex.operators.retrieval import retrieve
from helpdex.plans.skew import cut

EDGE = 0.01
#: Width of the buckets that scores are summed in.
WIDTH = 0.001


def measure(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, relevant, in_base, top_score, top_path, hit) of (qid, qvec, relevant) questions, whatever the score."""
    best = retrieve(questions.select("qid", "qvec"), entries, 1).select("qid", F.col("score").alias("top_score"), F.col("path").alias("top_path"))
    wanted = questions.select("qid", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    joined = wanted.join(best, "qid", "left").withColumns({"top_score": F.coalesce("top_score", F.lit(0.0)), "top_path": F.coalesce("top_path", F.lit(""))})
    return joined.select("qid", "relevant", (F.size("relevant") > 0).alias("in_base"), "top_score", "top_path", F.array_contains("relevant", F.col("top_path")).alias("hit"))


def scores(measured: DataFrame) -> DataFrame:
    """(top_score, inside, outside): the questions with and without an answer in the base by score, searched for once."""
    return cut(measured.groupBy("top_score").agg(F.count_if("in_base").alias("inside"), F.count_if(~F.col("in_base")).alias("outside")))


def candidates(measured: DataFrame) -> DataFrame:
    """(value, gap, correct, total, place): every threshold worth trying with the questions it judges right."""
    return thresholds(scores(measured))


def thresholds(by_score: DataFrame) -> DataFrame:
    """The candidates of ``scores``.

    A question is judged right if its score reaches the threshold exactly when its answer is in the base. Candidates are
    just below all scores, just above all, and halfway between neighbouring scores; ``gap`` is the distance of the
    neighbours (0 at the ends) and ``place`` the order among equals. Sums run over buckets of scores, then within
    each bucket.
    """
    placed = by_score.withColumn("bucket", F.floor(F.col("top_score") / WIDTH))
    across, within = Window.orderBy("bucket"), Window.partitionBy("bucket").orderBy("top_score")
    # scores are cosines, so there are at most 2 / WIDTH + 2 buckets; only the scores of one bucket share a task
    buckets = placed.groupBy("bucket").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"), F.max("top_score").alias("last"))
    carried = buckets.select(
        "bucket",
        F.lag("last").over(across).alias("carried_score"),
        F.coalesce(F.sum("o").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried_out"),
        F.coalesce(F.sum("i").over(across.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("carried_in"),
    )
    summed = placed.join(F.broadcast(carried), "bucket").select(
        "top_score",
        F.coalesce(F.lag("top_score").over(within), F.col("carried_score")).alias("before"),
        (F.col("carried_out") + F.coalesce(F.sum("outside").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("below_right"),
        (F.col("carried_in") + F.sum("inside").over(within.rowsBetween(Window.currentRow, Window.unboundedFollowing))).alias("above_right"),
    )
    totals = by_score.agg(F.min("top_score").alias("low"), F.max("top_score").alias("high"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where("low is not null")
    total = F.col("inside") + F.col("outside")
    ends = totals.select(F.col("low") - EDGE, F.lit(0.0), F.col("inside"), total, F.lit(0)).union(totals.select(F.col("high") + EDGE, F.lit(0.0), F.col("outside"), total, F.lit(1)))
    middle = summed.where("before is not null").join(F.broadcast(totals.select(total.alias("total")))).select((F.col("before") + F.col("top_score")) / 2, F.col("top_score") - F.col("before"), F.col("below_right") + F.col("above_right"), F.col("total"), F.lit(2))
    return ends.union(middle).toDF("value", "gap", "correct", "total", "place")


def suggest(measured: DataFrame) -> DataFrame:
    """One row (value, correct, total): most questions judged right, then the widest gap, then the first candidate.

    No row unless there are questions with and without an answer in the base.
    """
    by_score = scores(measured)
    classes = by_score.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where("inside > 0 and outside > 0")
    best = thresholds(by_score).orderBy(F.desc("correct"), F.desc("gap"), "place", "value").limit(1)
    return best.join(F.broadcast(classes)).select("value", "correct", "total")


def summary(measured: DataFrame) -> DataFrame:
    """One row: questions, in the base, hits, hit rate of those in the base."""
    inside = F.count_if("in_base")
    return measured.agg(F.count(F.lit(1)).alias("questions"), inside.alias("in_base"), F.count_if(F.col("in_base") & F.col("hit")).alias("hits"), F.round(F.when(inside > 0, F.count_if(F.col("in_base") & F.col("hit")) / inside), 6).alias("hit_rate"))
