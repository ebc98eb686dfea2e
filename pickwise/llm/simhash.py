"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` parts, so they meet under
one of the keys made of that many parts. Under a key, fingerprints are stored by bit plane, 64 to a machine word.
A row is compared with 64 others at a time: differing bits of three planes go through one carry-save adder
into vertical counters, and a word whose 64 lanes have all overflowed the radius is abandoned.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.llm.common import text_map
from pickwise.llm.graph import components, groups, labels, met, tiled
from pickwise.llm.textbytes import words_of
from pickwise.session import materialize

BITS, RADIUS, SEED = 64, 3, 42
U = np.uint64
ONE, ALL = U(1), U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint: a bit is one if more than half of the shingle hashes have it. No word: zero."""
    from xxhash import xxh64_intdigest

    words = words_of(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - k + 1].tolist()
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, end[k - 1:].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a signed number."""
    def rows(text):
        f = fingerprint(text, shingle)
        yield (f - (1 << 64) if f >> 63 else f,)

    return text_map(docs, "fp bigint", rows, id_col, text_col)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Fewest parts for which a key holds about 64 of n evenly spread fingerprints or fewer. Any choice finds every link."""
    b = radius + 1
    while b < 10 and n / 2 ** (BITS * (b - radius) / b) > 64:
        b += 1
    return b


def key_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the keys, signed."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(part, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row p, word w, bit i is bit p of fingerprint 64 * w + i."""
    n = -(-len(fp) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(len(fp), 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _lanes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Masks with bits lo..hi-1 set (0 <= lo < hi <= 64)."""
    return (ALL << lo.astype(np.uint64)) & (ALL >> (64 - hi).astype(np.uint64))


def near_pairs(fp: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 16):
    """Pairs (row, other) within the radius, other in first[row] .. last[row] - 1; yields blocks of pairs."""
    plane = planes(fp)
    rows = np.flatnonzero(last > first)
    w0, w1 = first[rows] // 64, (last[rows] - 1) // 64
    count = w1 - w0 + 1
    before = np.concatenate(([0], np.cumsum(count)))
    width = radius.bit_length()
    start_value = (1 << width) - 1 - radius  # the counters overflow just above the radius
    for lo in range(0, int(before[-1]), at_once):
        flat = np.arange(lo, min(lo + at_once, int(before[-1])))
        k = np.searchsorted(before, flat, "right") - 1
        r, w = rows[k], w0[k] + flat - before[k]
        live = _lanes(np.maximum(first[r] - 64 * w, 0), np.minimum(last[r] - 64 * w, 64))
        own = fp[r]
        counter = [np.full(len(r), ALL if start_value >> i & 1 else U(0)) for i in range(width)]

        def add(x, level):
            for i in range(level, width):
                counter[i], x = counter[i] ^ x, counter[i] & x
            return x

        for p in range(0, BITS, 3):
            x = [plane[q, w] ^ (U(0) - (own >> U(q) & ONE)) for q in range(p, min(p + 3, BITS))]
            if len(x) == 3:
                half = x[0] ^ x[1]
                low, high = half ^ x[2], (x[0] & x[1]) | (half & x[2])
                over = add(low, 0)
                over |= add(high, 1) if width > 1 else high
            else:
                over = add(x[0], 0)
            live &= ~over
            if p % 9 == 6:  # abandon the words in which no lane is left
                keep = live != 0
                if not keep.all():
                    r, w, live, own = r[keep], w[keep], live[keep], own[keep]
                    counter = [c[keep] for c in counter]
            if not len(r):
                break
        keep = live != 0
        if keep.any():
            r, w, live = r[keep], w[keep], live[keep]
            hit, lane = np.nonzero(np.unpackbits(live.astype("<u8").view(np.uint8).reshape(len(live), 8), axis=1, bitorder="little"))
            yield r[hit], 64 * w[hit] + lane


def tile_links(t: pa.Table, s: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest position's fingerprint) of the rows that links inside whole tiles bring together."""
    fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    part, ta, tb = (t.column(c).to_numpy() for c in ("part", "ta", "tb"))
    n = len(fp)
    group_end = np.repeat(s[1:], np.diff(s))
    # in a tile of two parts the rows of the first part meet those of the second
    in_first = (ta != tb) & (part == ta)
    firsts = np.concatenate(([0], np.cumsum(in_first)))
    boundary = np.repeat(s[:-1] + firsts[s[1:]] - firsts[s[:-1]], np.diff(s))
    at = np.arange(n)
    first = np.where(ta == tb, at + 1, boundary)
    last = np.where((ta == tb) | in_first, group_end, first)
    label = at
    for a, b in near_pairs(fp, first, last, radius):
        low = labels(n, np.concatenate((a, at)), np.concatenate((b, label)))
        label = low
    moved = label != at
    signed = fp.view(np.int64)
    return signed[moved], signed[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(a, b) between distinct fingerprints: a spanning set of all links within the radius.

    Two fingerprints may meet under several keys and then give the same link again.
    """
    distinct = materialize(fps.select("fp").distinct(), "fingerprints")
    masks = key_masks(blocks or blocks_for(distinct.count(), radius), radius)
    keyed = distinct.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])))
    keys = ["c", "key"]

    def run(batches):
        for t, s in groups(batches, [*keys, "ta", "tb"]):
            a, b = tile_links(t, s, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met(tiled(keyed, keys, "fp"), keys).mapInArrow(run, "a bigint, b bigint")


def roots(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of the fingerprints that links bring together."""
    return materialize(components(links(fps, radius)), "roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable by links.

    Every row gives a row. Null and empty texts have fingerprint zero and link like any other. Rows without an
    id link nothing and have no component. Rows that repeat an id count as rows of their own.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    named = fps.where(F.col(id_col).isNotNull())
    first = named.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    root = roots(named, radius)
    own = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = materialize(own.select("fp", "root").join(low, "root").select("fp", "component_id"), "components")
    out = fps.join(of_fp, "fp", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
