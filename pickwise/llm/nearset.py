"""Near-duplicates by exact Jaccard of word shingles; of those linked the smallest id stays.

A text is the set of its five-word shingles, as 64-bit hashes. Candidates come from two sources. The first is the SimHash
search of `simhash`, bit planes and all: fingerprints of the same shingles, and texts whose fingerprints links bring together
have a key in common. Its 64 bits can't find all pairs at Jaccard 0.8: such a pair differs in about ten bits, and a radius
that misses few of them leaves no selective key. So min-hashes add to it: BANDS keys of ROWS each, chosen so that a pair at
0.8 has no key in common with probability (1 - 0.8 ** ROWS) ** BANDS = 5e-5. Every candidate is compared by its whole set.

A text is dropped only for a text that stays and is similar itself, so the result is that of going through the texts
by id. That is done inside a task for every group of texts that candidates connect: sorted by id, each text is compared
with those kept before it under one of its keys, and a kept text is let go when its keys have no more members to come.
Keys of very many texts and groups too large for a task are thinned first by rounds over all of them: a text that is
the smallest under all its keys stays, those under its keys that are similar go. A key with n texts gives n comparisons
a round, never all pairs, and those with one text are dealt out in parts.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.llm import simhash
from pickwise.llm.common import discard, free_name, text_map
from pickwise.llm.graph import components
from pickwise.llm.textbytes import mix, span_hashes, window_hashes, word_hashes, words_of, WORD_BASE
from pickwise.session import materialize

SHINGLE, BANDS, ROWS, U = 5, 25, 5, np.uint64
SHARED, OF_UNION = 4, 5  # similar: at least 4 of 5 shingles of both together are shared
HUB, ROUNDS, IN_TASK, PART = 512, 4, 50_000, 2048  # texts of a key, rounds in a row, texts of a group in one task, comparisons with one text in one part
_rng = np.random.default_rng(11)
TURN, TIMES = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << U(1) | U(1) for _ in range(2))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle, a text without words none."""
    h = word_hashes(words_of(text, lower=True))
    return np.unique(window_hashes(h, min(size, len(h)))) if len(h) else h


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key per band."""
    if not len(s):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        np.minimum(low, ((s[at : at + 2048, None] ^ TURN) * TIMES).min(axis=0), out=low)
    start = np.arange(BANDS) * ROWS
    return mix(span_hashes(low, start, start + ROWS, WORD_BASE) + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, same, fp, keys): sig is Spark's xxhash64 of the text, same a hash of the whole shingle set, fp the SimHash fingerprint."""
    from xxhash import xxh64_intdigest

    def rows(text):
        s = shingles(text)
        sig = 42 if text is None else np.uint64(xxh64_intdigest(text.encode(), 42)).astype(np.int64).item()
        same = np.uint64(xxh64_intdigest(s.astype("<u8").tobytes(), 7)).astype(np.int64).item()
        yield sig, same, np.uint64(simhash.fingerprint(text, SHINGLE)).astype(np.int64).item(), band_keys(s).view(np.int64).tolist()

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return text_map(named, "sig bigint, same bigint, fp bigint, keys array<bigint>", rows, "id", "text")


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig) of the texts that stay."""
    made = materialize(sketches(docs, id_col, text_col), "sketches")
    # equal sets are one node, that of the smallest id
    nodes = materialize(made.groupBy("same").agg(F.min(F.struct("id", "sig")).alias("at"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select("same", "at.id", "at.sig", "fp", "keys"), "nodes")
    discard(made)
    worded = nodes.where(F.size("keys") > 0)  # texts without a word are one node, and like no other
    linked = worded.join(simhash_roots(worded), "fp").select("same", "id", F.xxhash64(F.lit("simhash"), "root").alias("key"))
    keyed = materialize(nodes.select("same", "id", F.explode("keys").alias("key")).unionByName(linked), "keys")
    shared = materialize(keyed.groupBy("key").count().where("count > 1").select("key"), "shared-keys")
    live = materialize(keyed.join(shared, "key", "left_semi"), "live")
    discard(keyed, shared)
    asked = materialize(nodes.join(live.select("same").distinct(), "same", "left_semi").select("same", "id", "sig"), "asked")
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("sig", F.xxhash64("t"))
    text = text.join(asked, ["id", "sig"]).dropDuplicates(["same"])
    sets = materialize(text_map(text, "set array<bigint>", lambda t: [(shingles(t).view(np.int64).tolist(),)], "same", "t"), "shingle-sets")

    most = live.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    gone, due = [asked.select("same").limit(0)], ROUNDS if most > HUB else 0
    while most:
        for _ in range(due):
            live, out = thinned(live, sets)
            gone.append(out)
        group = materialize(candidate_groups(live), "groups")
        wide = materialize(group.groupBy("root").count().where(F.col("count") > IN_TASK).select("root"), "wide-groups")
        gone.append(decided(live, group.join(wide, "root", "left_anti"), sets))
        if wide.isEmpty():
            break
        live, due = materialize(live.join(group.join(wide, "root"), "same").drop("root"), "live"), ROUNDS
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return nodes.join(out, "same", "left_anti").select("id", "sig")


def simhash_roots(nodes: DataFrame) -> DataFrame:
    """(fp, root): every fingerprint with that of its links; equal fingerprints need no link to have a root."""
    return (nodes.select("fp").distinct().join(simhash.roots(nodes).withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share at least SHARED of OF_UNION of their shingles."""
    if OF_UNION * min(len(a), len(b)) < SHARED * max(len(a), len(b)):
        return False
    n = len(np.intersect1d(a, b, assume_unique=True))
    return OF_UNION * n >= SHARED * (len(a) + len(b) - n)


def _ids(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["same"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``same`` of pairs (same, first) whose sets are similar. The set of ``first`` goes once to each part of its pairs."""
    parts = pairs.groupBy("first").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    hot = parts.where("parts > 1")
    asks = pairs.join(hot, "first", "left").select("same", "first", F.pmod(F.xxhash64("same"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    asks = asks.join(sets, "same").select("first", "part", F.lit(1).alias("late"), "same", "set")
    heads = parts.select(F.col("first").alias("same"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.join(sets, "same").select(F.col("same").alias("first"), "part", F.lit(0).alias("late"), "same", "set")

    def run(batches):
        head = None
        for b in batches:
            late, same, sets_of = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
            out = []
            for i in range(b.num_rows):
                s = sets_of[i].values.to_numpy()
                if not late[i]:
                    head = s.copy()
                elif similar(head, s):
                    out.append(same[i])
            yield _ids(out)

    dealt = heads.unionByName(asks).repartition("first", "part").sortWithinPartitions("first", "part", "late")
    return dealt.mapInArrow(run, "same bigint").distinct()


def thinned(live: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left of the keys, those that go) after one round over all keys."""
    low = materialize(live.groupBy("key").agg(F.min(F.struct("id", "same")).alias("m")), "low")
    asks = materialize(live.join(low, "key").groupBy("same", F.col("m.same").alias("first")).agg(F.lit(1).alias("one")).drop("one"), "asks")
    stay = materialize(asks.groupBy("same").agg(F.max(F.col("first") != F.col("same")).alias("waits")).where("not waits").select("same"), "stay")
    pairs = materialize(asks.where("same != first").join(stay.select(F.col("same").alias("first")), "first", "left_semi"), "pairs")
    gone = materialize(verified(pairs, sets), "gone")
    left = live.join(stay.unionByName(gone), "same", "left_anti")
    after = materialize(left, "live")
    discard(low, asks, stay, pairs, live)
    return after, gone


def candidate_groups(live: DataFrame) -> DataFrame:
    """(same, root) of the texts that have a key in common with another: groups that keys connect."""
    low = live.groupBy("key").agg(F.min("same").alias("b"), F.count("*").alias("n")).where("n > 1")
    return components(live.join(low, "key").select(F.col("same").alias("a"), "b")).withColumnRenamed("node", "same")


def decided(live: DataFrame, group: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``same`` of those that go, of whole groups (same, root), each gone through by id inside one task."""
    size = live.groupBy("key").agg(F.count("*").alias("n"))
    keys = live.join(size.where("n > 1"), "key").groupBy("same", "id").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("n"))  # at most BANDS + 1
    rows = keys.join(group, "same").join(sets, "same").select("root", "id", "same", "keys", "n", "set")

    def run(batches):
        root, kept, under, seen = None, {}, {}, {}  # kept: [set, keys with members to come]; under: kept ones by key
        for b in batches:
            out, roots, same, sets_of = [], b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(5)
            for i, (keys_of, n_of) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                if roots[i] != root:
                    root, kept, under, seen = roots[i], {}, {}, {}
                s, me = sets_of[i].values.to_numpy(), same[i]
                goes = any(similar(kept[k][0], s) for k in {k for key in keys_of for k in under.get(key, ())})
                if goes:
                    out.append(me)
                else:
                    kept[me] = [s.copy(), len(keys_of)]
                for key, n in zip(keys_of, n_of):
                    if not goes:
                        under.setdefault(key, []).append(me)
                    seen[key] = seen.get(key, 0) + 1
                    if seen[key] == n:
                        del seen[key]
                        for k in under.pop(key, ()):
                            kept[k][1] -= 1
                            if not kept[k][1]:
                                del kept[k]
            yield _ids(out)

    dealt = rows.repartition("root").sortWithinPartitions("root", "id", "same")
    return materialize(dealt.mapInArrow(run, "same bigint"), "gone")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, of repeated rows one. Rows without an id stay and drop nothing."""
    names = {x: free_name(x, docs.columns) for x in ("id", "sig")}
    first = materialize(firsts(docs, id_col, text_col), "firsts").select(*[F.col(k).alias(v) for k, v in names.items()])
    keyed = docs.select("*", F.col(id_col).cast("bigint").alias(names["id"]), F.xxhash64(F.col(text_col).cast("string")).alias(names["sig"]))
    kept = keyed.join(first, list(names.values())).dropDuplicates(list(names.values())).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
