"""Distributions, vocabularies and similarity profiles.

Counts are partial aggregates, so a token or site that holds a third of all rows costs one row per
task in the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.stopwords import PROFILE, SCORING
from ..session import stack
from ..sources.schema import OPS


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each value, over all rows or inside groups. The totals are sums of the counts."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
        out = counts.join(totals, list(by))
    else:
        out = counts.withColumn("_t", counts.agg(F.sum("n")).scalar())
    return out.withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def distinct_stats(df: DataFrame) -> DataFrame:
    """Rows, sites, tasks and the number of targets per task (two-level, so a hot task is pre-aggregated)."""
    pairs = df.groupBy("task", "target_id").agg(F.count(F.lit(1)).alias("n"))
    tasks = pairs.groupBy("task").agg(F.count("target_id").alias("targets"), F.sum("n").alias("n"))
    sites = df.groupBy("site_token").agg(F.count(F.lit(1)).alias("n")).agg(F.count("site_token"))
    return tasks.agg(F.sum("n").alias("rows"), F.count("task").alias("n_tasks"), F.avg("targets").alias("targets_mean"),
                     F.max("targets").alias("targets_max")).withColumn("n_sites", sites.scalar())


def site_bias(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Ops per site, and only sites whose CLICK share reaches the threshold."""
    p = df.groupBy("site_token").agg(*[F.count_if(F.col("op") == o).alias(o) for o in OPS], F.count("op").alias("total"))
    return p.withColumn("click_ratio", F.col("CLICK") / F.col("total")).filter(F.col("click_ratio") >= threshold)


def idf_table(df: DataFrame, tokens: str) -> DataFrame:
    """token, df, idf = ln((n+1)/(df+1)) + 1 over rows holding an array of tokens."""
    n = df.agg(F.count(F.lit(1))).scalar()
    counts = df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("token", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tag_priors(cand: DataFrame, ops: Sequence[str] = OPS) -> DataFrame:
    """P(tag | op) with add-one smoothing over all tags seen. `cand` has op, tag, is_target.

    One row per tag holds the counts of every op, so the op × tag grid is an unpivot of the counts.
    """
    hit = F.col("is_target") == 1
    per_tag = cand.groupBy("tag").agg(*[F.count_if(hit & (F.col("op") == o)).alias(o) for o in ops])
    long = per_tag.unpivot(["tag"], list(ops), "op", "n")
    totals = long.groupBy("op").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_tags"))
    return long.join(totals, "op").select("op", "tag", ((F.col("n") + 1) / (F.col("total") + F.col("n_tags"))).alias("prior"))


def describe_metric(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean, exact quartiles, p95, maximum, shares ≥ 0.5 and ≥ 0.3 and the empty share of each column.

    Values are counted first, so the exact quantiles work on distinct values: lengths are integers
    and ratios are rounded to `digits` places, which bounds the state for any number of rows.
    """
    long = df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) for c in cols]).unpivot([], list(cols), "metric", "v")
    counted = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("k"))
    q = F.expr("percentile(v, array(0.25D, 0.5D, 0.75D, 0.95D), k)")
    n = F.sum(F.when(F.col("v").isNotNull(), F.col("k")))
    over = lambda t: F.sum(F.when(F.col("v") >= t, F.col("k")).otherwise(0)) / n
    out = counted.groupBy("metric").agg(
        n.alias("n"), (F.sum(F.col("v") * F.col("k")) / n).alias("mean"), q.alias("_q"), F.max("v").alias("max"),
        over(0.5).alias("ge_05"), over(0.3).alias("ge_03"), (F.sum(F.when(F.col("v").isNull(), F.col("k")).otherwise(0)) / F.sum("k")).alias("empty_share"))
    names = ("p25", "median", "p75", "p95")
    return out.select("metric", "n", "mean", *[F.col("_q")[i].alias(c) for i, c in enumerate(names)], "max", "ge_05", "ge_03", "empty_share")


def quantiles(df: DataFrame, col: str, probs: Sequence[float] = (0.25, 0.5, 0.75, 0.95), accuracy: int = 10_000) -> DataFrame:
    """(p, value): exact quantiles with linear interpolation of a column with any number of distinct values.

    A mergeable sketch brackets every quantile: the value it names has a rank within n / accuracy of the wanted one. A second
    pass counts what lies below the brackets and the values inside, about 4 n / accuracy of them each, and nothing else is
    shuffled. Nulls don't count; an empty column gives nulls.
    """
    d = df.select(F.col(col).cast("double").alias("v")).filter("v is not null")
    slack = 2.0 / accuracy
    edges = [max(0.0, p - slack) for p in probs], [min(1.0, p + slack) for p in probs]
    lows, highs, n = d.agg(F.percentile_approx("v", edges[0], accuracy), F.percentile_approx("v", edges[1], accuracy), F.count("v")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([(float(p), None) for p in probs], "p double, value double")
    at = [p * (n - 1) for p in probs]
    inside = [F.col("v").between(F.lit(lo), F.lit(hi)) for lo, hi in zip(lows, highs)]
    below = d.agg(*[F.count_if(F.col("v") < F.lit(lo)).alias(f"b{i}") for i, lo in enumerate(lows)]).first()
    held = d.withColumn("i", F.explode(F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda x: x.isNotNull()))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("k"))
    upto = held.withColumn("upto", F.sum("k").over(Window.partitionBy("i").orderBy("v")) + F.element_at(F.array(*[F.lit(b).cast("long") for b in below]), F.col("i") + 1))
    # the value at 0-based rank r is the first one with more than r values up to it
    value = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    rank = lambda f: F.element_at(F.array(*[F.lit(int(f(x))).cast("long") for x in at]), F.col("i") + 1)
    from math import ceil, floor
    part = F.element_at(F.array(*[F.lit(x - floor(x)) for x in at]), F.col("i") + 1)
    two = upto.groupBy("i").agg(value(rank(floor)).alias("a"), value(rank(ceil)).alias("b"))
    return two.select(F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("p"), (F.col("a") + (F.col("b") - F.col("a")) * part).alias("value"))


# ---------------------------------------------------------------- vocabularies

def token_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """token, n_a, n_b over two token-array columns; one scan, one shuffle of partial counts."""
    side = lambda c, s: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(int(s == "a")).alias("a"), F.lit(int(s == "b")).alias("b")))
    both = df.select(F.explode(F.concat(side(a, "a"), side(b, "b"))).alias("x")).select("x.*")
    return both.groupBy("token").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def with_totals(counts: DataFrame) -> DataFrame:
    """Attach the two column totals to token counts (one scalar subquery)."""
    totals = counts.agg(F.struct(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"))).scalar()
    return counts.withColumn("_s", totals).select("*", F.col("_s.a").alias("sum_a"), F.col("_s.b").alias("sum_b")).drop("_s")


def top_tokens(counts: DataFrame, n: int = 25) -> DataFrame:
    """Most frequent tokens over both columns with their relative frequencies."""
    top = with_totals(counts).orderBy((F.col("n_a") + F.col("n_b")).desc(), "token").limit(n)
    return top.select("token", "n_a", "n_b", (F.col("n_a") / F.greatest("sum_a", F.lit(1))).alias("freq_a"), (F.col("n_b") / F.greatest("sum_b", F.lit(1))).alias("freq_b"))


def vocab_overlap(counts: DataFrame) -> DataFrame:
    a, b = F.col("n_a") > 0, F.col("n_b") > 0
    return counts.agg(F.count_if(a).alias("vocab_a"), F.count_if(b).alias("vocab_b"), F.count_if(a & b).alias("common"),
                      (F.count_if(a & b) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("jaccard"))


def js_divergence(counts: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of the two token distributions."""
    d = with_totals(counts).select((F.col("n_a") / F.col("sum_a")).alias("p"), (F.col("n_b") / F.col("sum_b")).alias("q"))
    d = d.withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0))
    return d.agg(((part("p") + part("q")) / 2).alias("js"))


def exclusive_tokens(counts: DataFrame, side: str = "a", n: int = 10) -> DataFrame:
    mine, other = f"n_{side}", "n_b" if side == "a" else "n_a"
    return counts.filter(F.col(other) == 0).orderBy(F.col(mine).desc(), "token").limit(n).select("token", F.col(mine).alias("n"))


# ---------------------------------------------------------------- bins

# Buckets of the number of open tokens.
OPEN_BINS = ((0, 0), (1, 3), (4, 6), (7, 9), (10, 14), (15, None))


def binned_accuracy(df: DataFrame, size: str, hit: str, bins=OPEN_BINS) -> DataFrame:
    """Accuracy per size bucket (the last one is open); empty buckets stay in the report.

    One row of conditional aggregates, turned into one row per bucket.
    """
    inside = lambda b: F.col(size) >= b[0] if b[1] is None else F.col(size).between(*b)
    name = lambda b: f"{b[0]}+" if b[1] is None else f"{b[0]}-{b[1]}"
    row = df.agg(*[F.struct(F.count_if(inside(b)).alias("n"), F.coalesce(F.avg(F.when(inside(b), F.col(hit).cast("double"))), F.lit(0.0)).alias("accuracy"))
                   .alias(name(b)) for b in bins])
    return row.unpivot([], row.columns, "bin", "v").select("bin", "v.n", "v.accuracy")


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal-width bins on [lo, hi]; the last bin is closed, values outside are left out."""
    v = F.col(col).cast("double")
    b = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(v.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_int(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_to_p99(df: DataFrame, cols: Sequence[str], bins: int = 60) -> DataFrame:
    """Equal-width bins from 0 to the p99 of all listed integer columns together."""
    long = df.unpivot([], list(cols), "metric", "v").groupBy("metric", "v").agg(F.count(F.lit(1)).alias("k"))
    top = long.agg(F.expr("cast(floor(percentile(v, 0.99D, k)) as double)"))
    d = long.withColumn("_hi", top.scalar()).filter("v between 0 and _hi")
    b = F.least(F.floor(F.col("v") / (F.col("_hi") / bins)), F.lit(bins - 1)).cast("int")
    return d.groupBy("metric", b.alias("bin")).agg(F.sum("k").alias("n"))


def group_sizes(df: DataFrame, by: str = "id") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), col).limit(n)


# ---------------------------------------------------------------- key sets

def key_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def key_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def site_overlap(train: DataFrame, test: DataFrame, key: str = "site_token") -> DataFrame:
    """How many keys are only in one frame or in both; one full pass over pre-aggregated keys."""
    side = lambda df, i: df.select(key).distinct().select(key, F.lit(i == 0).alias("a"), F.lit(i == 1).alias("b"))
    keys = stack(side(train, 0), side(test, 1)).groupBy(key).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    return keys.agg(F.count_if(a & ~b).alias("only_train"), F.count_if(~a & b).alias("only_test"), F.count_if(a & b).alias("both"))


# ---------------------------------------------------------------- profiles

def length_profile(df: DataFrame) -> DataFrame:
    """Characters and raw words of task and history (rows that have a history)."""
    words = lambda c: F.size(F.filter(tx.alpha_list(c), lambda t: t != ""))
    d = df.filter(tx.text("history") != "").select(
        F.length("task").alias("task_chars"), F.length("history").alias("history_chars"), words("task").alias("task_words"), words("history").alias("history_words"))
    return describe_metric(d, d.columns)


def row_similarity(df: DataFrame) -> DataFrame:
    """Task to history similarity per row: Jaccard, overlap-min, Dice, set sizes."""
    d = df.filter(tx.text("history") != "").select("id", tx.token_set("task", PROFILE).alias("a"), tx.token_set("history", PROFILE).alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.select("id", tx.jaccard(a, b).alias("jaccard"), tx.overlap_min(a, b).alias("overlap_min"), tx.dice(a, b).alias("dice"),
                    tx.common(a, b).alias("inter"), F.size(F.array_union(a, b)).alias("union"), F.size(a).alias("task_size"), F.size(b).alias("history_size"))


def remaining_scores(df: DataFrame, stop: Sequence[str] = SCORING) -> DataFrame:
    """Open tokens against all candidates together, the target, and the other candidates; per row, no shuffle."""
    from .rank import cand_text, target_pos

    d = df.filter(tx.text("history") != "").select("id", "target_id", "cands", tx.token_set("task", stop).alias("t"), tx.token_set("history", stop).alias("h"))
    d = d.withColumn("r", tx.remaining(F.col("t"), F.col("h"))).withColumn("p", target_pos()).withColumn(
        "c", F.transform("cands", lambda c: tx.token_set(cand_text(c), stop)))
    r = F.col("r")
    d = (d.withColumn("all_c", F.array_distinct(F.flatten("c")))
         .withColumn("cov", F.when(F.size(r) > 0, F.transform("c", lambda c: tx.coverage(r, c))))
         .withColumn("jac", F.when(F.size(r) > 0, F.transform("c", lambda c: tx.jaccard(r, c)))))
    others = lambda s: F.filter(s, lambda x, i: F.coalesce(i != F.col("p"), F.lit(True)))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    at = lambda s: F.when(F.col("p").isNotNull(), F.try_element_at(s, F.col("p") + 1))
    cov, jac, allc = F.col("cov"), F.col("jac"), F.col("all_c")
    behind = F.size(F.filter(cov, lambda x, i: F.coalesce(i != F.col("p"), F.lit(True)) & (x >= at(cov))))
    return d.select(
        "id", F.size("t").alias("task_size"), F.size("h").alias("history_size"), F.size("r").alias("open_size"), F.size("all_c").alias("cand_size"),
        tx.jaccard(r, allc).alias("jac_all"), tx.overlap_min(r, allc).alias("ovl_all"), tx.dice(r, allc).alias("dice_all"), tx.coverage(r, allc, None).alias("cov_all"),
        at(jac).alias("jac_target"), at(cov).alias("cov_target"), mean(others(jac)).alias("jac_others_mean"), F.array_max(others(jac)).alias("jac_others_max"),
        mean(others(cov)).alias("cov_others_mean"), F.array_max(others(cov)).alias("cov_others_max"),
        F.when(F.col("p").isNotNull() & (F.size(r) > 0), behind + 1).alias("target_rank_last"))
