"""Scores, picks, ranks and normalisation inside a decision.

A decision carries its candidates, so picks work on the array and need no shuffle. The long-frame
forms (one row per candidate) use windows partitioned by id.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.stopwords import SCORING
from ..session import pin

BY = "id"


def cand_text(c: Column) -> Column:
    return F.concat(tx.text(c["text"]), F.lit(" "), tx.text(c["attrs"]))


def with_token_sets(df: DataFrame, stop: Sequence[str] = SCORING) -> DataFrame:
    """Task tokens `t`, history tokens `h`, still open tokens `r` and one token set per candidate `ctoks`."""
    return (df.withColumn("t", tx.token_set("task", stop)).withColumn("h", tx.token_set("history", stop))
            .withColumn("r", tx.remaining(F.col("t"), F.col("h")))
            .withColumn("ctoks", F.transform("cands", lambda c: tx.token_set(cand_text(c), stop))))


def with_scores(df: DataFrame) -> DataFrame:
    """Array `scores`: coverage of the open tokens, or Jaccard with the task when none is open."""
    t, r = F.col("t"), F.col("r")
    by_cov = F.transform("ctoks", lambda c: tx.common(r, c) / F.size(r))
    by_jac = F.transform("ctoks", lambda c: tx.jaccard(t, c))
    return df.withColumn("scores", F.when(F.size(r) > 0, by_cov).otherwise(by_jac))


def argmax_pos(scores: Column) -> Column:
    """0-based position of the largest score, the first one on ties; null for an empty array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pick_target(df: DataFrame, stop: Sequence[str] = SCORING) -> DataFrame:
    """Coverage heuristic: adds `pick_pos`, `pick` (candidate struct), `pick_id`, `pick_score`, `n_open`."""
    out = with_scores(with_token_sets(df, stop)).withColumn("pick_pos", argmax_pos(F.col("scores")))
    pick = F.try_element_at("cands", F.col("pick_pos") + 1)
    out = (out.withColumn("pick", pick).withColumn("pick_score", F.coalesce(F.array_max("scores"), F.lit(0.0))).withColumn("n_open", F.size("r"))
           .drop("t", "h", "r", "ctoks", "scores"))
    return pin(out, "pick_pos", "pick", "pick_score", "n_open").withColumn("pick_id", tx.text(F.col("pick")["candidate_id"]))


def rank_in_row(scores: Column, pos: Column) -> Column:
    """1-based rank of the entry at `pos` (0-based): larger scores first, then earlier position."""
    mine = F.try_element_at(scores, pos + 1)
    better = F.filter(scores, lambda s, i: (s > mine) | ((s == mine) & (i < pos)))
    return F.size(better) + 1


def target_pos(cands: str = "cands", target: str = "target_id") -> Column:
    """0-based position of the target, null when it is not among the candidates."""
    ids = F.transform(cands, lambda c: c["candidate_id"])
    return F.nullif(F.array_position(ids, F.col(target)), F.lit(0).cast("long")).cast("int") - 1


def with_target_rank(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Rank of the target; a missing target ranks behind every candidate."""
    pos = target_pos()
    return df.withColumn("_p", pos).withColumn(
        "target_rank", F.when(F.col("_p").isNull(), F.size(scores) + 1)
        .otherwise(rank_in_row(F.col(scores), F.col("_p")))).drop("_p")


# ---------------------------------------------------------------- long frame

def group_norm(df: DataFrame, cols: Sequence[str], by: str = BY) -> DataFrame:
    """Per group: min-rank scaled to [0,1], z-score (sample deviation), share of the maximum."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    out = df
    for c in cols:
        v = F.col(c)
        sd = F.coalesce(F.stddev_samp(v).over(w), F.lit(1.0))
        sd = F.when(sd < 1e-9, 1.0).otherwise(sd)
        mx = F.max(v).over(w)
        out = (out.withColumn(f"{c}_rank", (F.rank().over(w.orderBy(v.desc())) - 1) / F.greatest(n - 1, F.lit(1)))
               .withColumn(f"{c}_z", (v - F.avg(v).over(w)) / sd)
               .withColumn(f"{c}_fmax", v / F.when(mx == 0, F.lit(1.0)).otherwise(mx)))
    return out


def with_tag_count(df: DataFrame, by: str = BY) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(by, "tag"))
    return df.withColumn("tag_count", n).withColumn("tag_unique", (n == 1).cast("int"))


def target_rank(cand: DataFrame, score: str, by: str = BY) -> DataFrame:
    """Rank of the target row of each group, as a single partial aggregate instead of a sort.

    The group's target is found first (`max_by` of its score and position), then the candidates
    that beat it are counted; groups without a target get their size plus one.
    """
    tgt = cand.filter("is_target = 1").groupBy(by).agg(F.min("cand_pos").alias("_tp"), F.min_by(score, "cand_pos").alias("_ts"))
    j = cand.join(tgt, by, "left")
    beats = (F.col(score) > F.col("_ts")) | ((F.col(score) == F.col("_ts")) & (F.col("cand_pos") < F.col("_tp")))
    return j.groupBy(by).agg(
        F.when(F.max("_tp").isNull(), F.count(F.lit(1)) + 1).otherwise(F.count_if(beats) + 1).cast("int").alias("target_rank"))


def target_vs_others(cand: DataFrame, score: str, by: str = BY) -> DataFrame:
    """Target score beside the mean and maximum of the other candidates."""
    is_t = F.col("is_target") == 1
    return cand.groupBy(by).agg(
        F.max(F.when(is_t, F.col(score))).alias("target"),
        F.avg(F.when(~is_t, F.col(score))).alias("others_mean"),
        F.max(F.when(~is_t, F.col(score))).alias("others_max"))


def win_rates(tvo: DataFrame) -> DataFrame:
    """How often the target beats the mean and the maximum of the others."""
    ok = tvo.filter("target is not null and others_mean is not null")
    share = lambda c: F.avg(c.cast("double"))
    return ok.agg(share(F.col("target") > F.col("others_mean")).alias("gt_mean"),
                  share(F.col("target") > F.col("others_max")).alias("gt_max"),
                  share(F.col("target") >= F.col("others_max")).alias("ge_max"),
                  F.count(F.lit(1)).alias("n"))


def target_positions(cand: DataFrame) -> DataFrame:
    return cand.filter("is_target = 1").groupBy("cand_pos").agg(F.count(F.lit(1)).alias("n"))


def top1(cand: DataFrame, score: str, by: str = BY) -> DataFrame:
    """Best candidate per group, lowest position on ties. Partial aggregation, no sort of whole groups."""
    best = F.max_by(F.struct("candidate_id", "cand_pos", score), F.struct(F.col(score), -F.col("cand_pos")))
    return cand.groupBy(by).agg(best.alias("_b")).select(by, "_b.*")


def cosine_topk(query: DataFrame, items: DataFrame, k: int, by: str = BY) -> DataFrame:
    """Top k items of each group by cosine with the group's query vector (ties: smaller item id).

    `query(by, q)` and `items(by, item_id, v)` hold array<float> vectors. The group limit is pushed
    below the shuffle by the ranked-window rule.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    j = items.join(query, by)
    q, v = F.col("q"), F.col("v")
    cos = F.round(dot(q, v) / F.sqrt(dot(q, q) * dot(v, v)), 9)
    w = Window.partitionBy(by).orderBy(F.col("cosine").desc(), "item_id")
    return (j.select(by, "item_id", cos.alias("cosine")).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def topk_accuracy(ranked: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return ranked.agg(*[F.avg((F.col("target_rank") <= k).cast("double")).alias(f"top{k}") for k in ks])


def ndcg(ranked: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Mean NDCG with one relevant item per decision."""
    gain = 1 / F.log2(F.col("target_rank") + 1)
    return ranked.agg(*[F.avg(F.when(F.col("target_rank") <= k, gain).otherwise(0.0)).alias(f"ndcg{k}") for k in ks])


def baselines(df: DataFrame, seed: int = 0) -> DataFrame:
    """First-candidate, hash-random and expected-random hit rates."""
    ids = F.transform("cands", lambda c: c["candidate_id"])
    drawn = F.array_min(F.transform(ids, lambda i: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), i)).alias("h"), i.alias("i"))))["i"]
    hit = lambda c: F.avg((c == F.col("target_id")).cast("double"))
    return df.filter(F.size("cands") > 0).agg(
        hit(F.try_element_at(ids, F.lit(1))).alias("first"), hit(drawn).alias("random"),
        F.avg(1 / F.size("cands")).alias("expected"))
