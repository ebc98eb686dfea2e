"""Reproducible splits and folds by keyed hash.

The boundary of a split is one (hash, key) pair, found from bucket counts and one bucket's rows; each
row then compares itself with it. Nothing is sorted as a whole, no row is shuffled, and a group that
holds a third of all rows costs nothing extra.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import md5_key

# Fixed value: hex digits of a hash bucket (65,536 buckets).
BUCKET_DIGITS = 4


def _keyed(df: DataFrame, key: str, seed: int) -> DataFrame:
    h = md5_key(seed, key)
    return df.select(F.substring(h, 1, BUCKET_DIGITS).alias("b"), h.alias("h"), F.col(key).cast("string").alias("k"))


def boundary(df: DataFrame, key: str, wanted: Column, seed: int) -> Column:
    """struct<h,k> of the `wanted`-th smallest keyed hash (a scalar subquery); null when it is 0.

    `wanted` is an expression over `n`, the number of rows.
    """
    rows = _keyed(df, key, seed)
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    # at most 16^BUCKET_DIGITS rows
    total = counts.agg(F.sum("c")).scalar()
    run = counts.withColumn("cum", F.sum("c").over(Window.orderBy("b"))).withColumn("n", total).withColumn("want", wanted.cast("long"))
    at = run.filter("cum >= want and cum - c < want").select("b", (F.col("want") - (F.col("cum") - F.col("c"))).alias("left"))
    hit = rows.join(F.broadcast(at), "b").withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", "k"))).filter("r = left")
    return hit.agg(F.max(F.struct("h", "k"))).scalar()


def inside(key: str, cut: Column, seed: int) -> Column:
    mine = F.struct(md5_key(seed, key).alias("h"), F.col(key).cast("string").alias("k"))
    return F.coalesce(mine <= cut, F.lit(False))


def sample_exact(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """The n rows of smallest keyed hash, for n too large for a top-n sort. Keys are unique."""
    cut = boundary(df, key, F.least(F.lit(n), F.col("n")), seed)
    return df.filter(inside(key, cut, seed))


def row_split(df: DataFrame, frac: float = 0.2, seed: int = 0, key: str = "id") -> DataFrame:
    """Adds `is_valid`: exactly floor(frac · n) rows."""
    cut = boundary(df, key, F.floor(F.col("n") * F.lit(frac) + 1e-9), seed)
    return df.withColumn("is_valid", inside(key, cut, seed))


def group_split(df: DataFrame, group: str = "site_token", frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `is_valid`: all rows of ceil(frac · groups) groups."""
    groups = df.select(group).distinct()
    cut = boundary(groups, group, F.ceil(F.col("n") * F.lit(frac) - 1e-9), seed)
    return df.withColumn("is_valid", inside(group, cut, seed))


def snake_folds(df: DataFrame, group: str = "site_token", k: int = 5) -> DataFrame:
    """(group, size, fold): groups by falling size dealt forth and back over k folds; the same rule at every number of groups.

    The rank has three levels, so no task sees all groups: offsets of size ranges (a bounded number of them, by
    the logarithm of the size), offsets per (size, hash prefix) inside a range, and a rank inside that. Equal
    sizes follow the hash of the group.
    """
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("h", md5_key(group)).withColumn("b", F.substring("h", 1, 2))
    # sizes of one range are neighbours; 63 doublings of 16 steps at most
    cells = g.groupBy("size", "b").agg(F.count(F.lit(1)).alias("c")).withColumn("range", F.floor(F.log2("size") * 16))
    wide = cells.groupBy("range").agg(F.sum("c").alias("c"))
    wide = wide.select("range", (F.sum("c").over(Window.orderBy(F.col("range").desc())) - F.col("c")).alias("before"))
    near = Window.partitionBy("range").orderBy(F.col("size").desc(), "b")
    offs = cells.withColumn("off", F.sum("c").over(near) - F.col("c")).join(wide, "range").select("size", "b", (F.col("before") + F.col("off")).alias("off"))
    r = g.join(offs, ["size", "b"]).withColumn("i", F.col("off") + F.row_number().over(Window.partitionBy("size", "b").orderBy("h", group)) - 1)
    lap, at = F.floor(F.col("i") / k), F.col("i") % k
    return r.select(group, "size", F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def fold_loads(df: DataFrame, group: str = "site_token", k: int = 5) -> DataFrame:
    """(fold, n_groups, n_rows) of the fold rule."""
    return snake_folds(df, group, k).groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_rows"))


def with_fold(df: DataFrame, k: int = 5, group: str = "site_token") -> DataFrame:
    """Adds `fold` by balanced groups."""
    return df.join(snake_folds(df, group, k).select(group, "fold"), group)
