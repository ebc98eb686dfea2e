"""Embedding near-duplicates by collision-counting projections.

Vectors of one label are projected on many random directions and sorted along each. Around a query's own
projection a window of fixed half-width is cut out of every sorted list, and the collisions of each partner are
counted over all windows. Partners with enough collisions are verified by their exact cosine. The half-width is
a share of the distance that the cosine bound allows; the count is the largest one that loses a pair right at
the bound with a probability of at most ``miss``. Pairs closer than the bound are lost less often still.
"""
from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.llm.graph import components, groups, labels, met, tiled
from pickwise.session import materialize

COSINE, DIRECTIONS, WIDTH, MISS, TILE = 0.93, 96, 0.5, 1e-4, 2048


def least_count(directions: int = DIRECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Largest count that a pair at the bound reaches with a probability of 1 - miss; width is in units of its distance."""
    p, below = erf(width / sqrt(2)), 0.0
    for count in range(directions + 1):
        below += comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > miss:
            return count
    return directions


@lru_cache(maxsize=16)
def directions_of(dim: int, directions: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((dim, directions))


def window_pairs(queries: np.ndarray, others: np.ndarray, cosine: float, same: bool, directions: int = DIRECTIONS, width: float = WIDTH, miss: float = MISS):
    """Verified pairs (query, other) of unit rows with a cosine of at least the bound; ``same``: both are one set, pairs once."""
    least, half = least_count(directions, width, miss), width * sqrt(max(0.0, 2 - 2 * cosine))
    project = directions_of(queries.shape[1], directions)
    pq, po = queries @ project, others @ project
    order = np.argsort(po, axis=0, kind="stable").astype(np.int32)
    lo, hi = np.empty(pq.shape, np.int64), np.empty(pq.shape, np.int64)
    for j in range(directions):
        line = po[order[:, j], j]
        lo[:, j] = np.searchsorted(line, pq[:, j] - half, "left")
        hi[:, j] = np.searchsorted(line, pq[:, j] + half, "right")
    lists = [np.ascontiguousarray(order[:, j]) for j in range(directions)]
    for i in range(len(queries)):
        a, b = lo[i].tolist(), hi[i].tolist()
        count = np.bincount(np.concatenate([o[x:y] for o, x, y in zip(lists, a, b)]), minlength=len(others))
        found = np.flatnonzero(count >= least)
        if same:
            found = found[found > i]
        if len(found):
            found = found[others[found] @ queries[i] >= cosine]
            if len(found):
                yield i, found


def tile_result(x: np.ndarray, weight: np.ndarray, n_first: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links with weights, smallest position linked) of the rows of one tile; n_first rows are its first part (0: one part)."""
    n, links, left, right = len(x), np.zeros(len(x), np.int64), [], []
    queries, others, shift = (x[:n_first], x[n_first:], n_first) if n_first else (x, x, 0)
    if len(queries) and len(others):
        for i, found in window_pairs(queries, others, cosine, not n_first):
            found = found + shift
            links[i] += weight[found].sum()
            links[found] += weight[i]
            left.append(np.full(len(found), i))
            right.append(found)
    low = labels(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)
    return links, low


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows without id or label, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing: no links, their own component, kept if they have an id. Vectors link only inside their label and length.
    Equal vectors are compared once and counted each: rows that repeat count as vectors of their own. Labels may be of any type
    that can be grouped; they are numbered, and only equal ones meet (as in grouping, NaN equals NaN).
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    unfit = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(unfit, F.lit(True)) & F.exists("x", lambda v: v != 0)
    rows = materialize(rows.select("id", "label", F.when(sound, F.col("x")).alias("x")), "vectors")
    sets = materialize(rows.where("x is not null").groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("x")), "vector-sets")

    def run(batches):
        for t, s in groups(batches, ["k", "dim", "ta", "tb"]):
            x = t.column("x").combine_chunks()
            flat, at = x.flatten().to_numpy(), np.concatenate(([0], np.cumsum(t.column("dim").to_numpy().astype(np.int64))))
            part, ta, tb, rep, n = (t.column(c).to_numpy() for c in ("part", "ta", "tb", "rep", "n"))
            for a, b in zip(s, s[1:]):
                m = flat[at[a] : at[b]].reshape(b - a, -1)
                m = m / np.abs(m).max(axis=1, keepdims=True)
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                two = ta[a] != tb[a]
                n_first = int((part[a:b] == ta[a]).sum()) if two else 0
                if two and n_first in (0, b - a):
                    continue
                found, low = tile_result(m, n[a:b], n_first, cosine)
                hit = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(rep[a:b][hit]), pa.array(found[hit]), pa.array(rep[a:b][low[hit]])], names=["rep", "n", "low"])

    numbered = materialize(sets.select("label").distinct().withColumn("k", F.monotonically_increasing_id()), "labels")
    keyed = sets.join(numbered, "label").select("rep", "n", "x", "dim", "k")
    keys = ["k", "dim"]
    found = materialize(met(tiled(keyed, keys, "rep", TILE), keys).mapInArrow(run, "rep bigint, n bigint, low bigint"), "collisions")
    root = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    # representatives are the smallest ids of their vectors, so the smallest representative is the smallest id
    of_set = (sets.join(found.groupBy("rep").agg(F.sum("n").alias("m")), "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
              .select("label", "x", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    linked = rows.where("x is not null").join(of_set, ["label", "x"]).select("id", "n_links", "component_id")
    alone = rows.where("x is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
