"""Ensembles of fold predictions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stack


def vote(preds: DataFrame, n_folds: int, ids: DataFrame | None = None) -> DataFrame:
    """Majority of whole (op, target_id, value) triples per id; ties go to the lowest fold.

    Rows are partitioned by id once; both aggregates use that partitioning. Ids without a vote get
    the default answer when `ids` is given.
    """
    per = (preds.repartition("id").groupBy("id", "op", "target_id", "value")
           .agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("first")))
    best = F.max_by(F.struct("op", "target_id", "value", "n"), F.struct("n", (-F.col("first")).alias("k")))
    won = per.groupBy("id").agg(best.alias("b")).select("id", "b.op", "b.target_id", "b.value", (F.col("b.n") == n_folds).alias("unanimous"))
    if ids is None:
        return won
    fill = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return ids.select("id").join(won, "id", "left").select("id", fill("op", "CLICK"), fill("target_id", ""), fill("value", ""), fill("unanimous", False))


def unanimity(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count(F.lit(1)).alias("ids"), F.count_if("unanimous").alias("unanimous"), F.avg(F.col("unanimous").cast("double")).alias("rate"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames of the same columns."""
    return stack(*frames)
