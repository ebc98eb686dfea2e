"""Links between many rows: hot groups cut into tiles, groups streamed through a task, connected components."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.session import materialize

TILE = 1024
I64 = pa.int64()


def tiled(df: DataFrame, keys: list[str], row_key: str, size: int = TILE) -> DataFrame:
    """Rows with ``part``, ``ta``, ``tb``: every two rows of a key meet in the tile (ta, tb) of their parts.

    A key with n rows has ceil(n / size) parts, chosen by a hash of the row; a key of up to ``size`` rows is
    one tile. All pairs of a key are met, and no tile holds much more than two parts.
    """
    hot = df.groupBy(*keys).count().where(F.col("count") > size).select(*keys, F.ceil(F.col("count") / size).cast("int").alias("parts"))
    n = F.coalesce("parts", F.lit(1))
    out = df.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(row_key, F.lit(1)), n).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least("part", j).alias("ta"), F.greatest("part", j).alias("tb")))
    return out.select(*df.columns, "part", F.inline(tile))


def met(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bring every tile together and in order of its parts; for ``groups``."""
    g = df.withColumn("g", F.xxhash64(*keys, "ta", "tb"))
    return g.repartition("g").sortWithinPartitions("g", *keys, "ta", "tb", "part")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their group starts (and the end), from rows that come sorted by group.

    Only the last, unfinished group is carried over to the next batch.
    """
    held: list[pa.RecordBatch] = []
    rows, least = 0, 1

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < 1 << 15 or rows < least:
            continue
        t = pa.Table.from_batches(held)
        s = starts(t)
        if len(s) > 2:
            yield t.slice(0, s[-2]), s[:-1]
            t = t.slice(s[-2])
        held, rows = t.to_batches(), t.num_rows
        least = 2 * rows  # a large group isn't looked through again with every batch
    if held and rows:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable by links a-b, for positions below n."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (before == label).all():
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds; every round is written to the shared folder, and the small
    tables of minima are read back so that joins on a hub can be split.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark["n"], mark["x"]) == seen or mark["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = (mark["n"], mark["x"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        e = materialize(large.join(low2, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "links")
