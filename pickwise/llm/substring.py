"""Substring dedup on a compacted De Bruijn graph of the corpus.

A window of 50 words is an edge; windows of a document overlap in all words but one. The graph is built sparsely:
every window is filed under its smallest k-mer (by hash), its anchor, so neighbouring windows share an anchor and
form one path around it. Paths are compacted with joins:

1. anchors that occur in one document only are dropped; the other paths are merged by (anchor, content), with
   their lowest source coordinates: a class;
2. an anchor with one class is nonbranching: all its windows have the class's sources, so one number serves all;
3. the windows of branching anchors are read again at their source coordinates, once per class, and matched by a
   128-bit hash of all 50 words.

Equal windows have equal anchors, so nothing is lost; only anchors, never all windows, are shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.llm.common import free_name, text_map
from pickwise.llm.textbytes import WORD_BASE, WORD_BASE_2, covered, span_hashes, window_hashes, word_hashes, words_of
from pickwise.session import materialize

WINDOW, KMER = 50, 12
KEY = ["a", "ctx", "n"]


def paths(text: str | None, window: int = WINDOW, kmer: int = KMER):
    """(anchor hash, content hash, number of windows, first window) of each run of windows with one anchor."""
    h = word_hashes(words_of(text))
    if len(h) < window:
        return [], [], [], []
    k = window_hashes(h, kmer)
    span = window - kmer + 1
    anchor = np.arange(len(h) - window + 1)
    for at in range(0, len(anchor), 1 << 15):  # bounded views for very long texts
        part = np.lib.stride_tricks.sliding_window_view(k[at : at + (1 << 15) + span - 1], span)
        anchor[at : at + len(part)] += part.argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    n = np.diff(np.append(first, len(anchor)))
    content = span_hashes(h, first, first + n - 1 + window, WORD_BASE_2) ^ ((anchor[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return k[anchor[first]].view(np.int64).tolist(), content.view(np.int64).tolist(), n.tolist(), first.tolist()


def occurrences(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(id, sig, a, ctx, n, p0) of every path; sig tells texts with one id apart."""
    from xxhash import xxh64_intdigest

    def rows(text):
        sig = np.uint64(xxh64_intdigest((text or "").encode(), 42)).astype(np.int64).item()
        return [(sig, *r) for r in zip(*paths(text, window, kmer))]

    return text_map(docs.where("id is not null"), "sig bigint, a bigint, ctx bigint, n int, p0 int", rows, "id", "text")


def _join_text(docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
    return docs.withColumn("sig", F.xxhash64("text")).join(small, ["id", "sig"], how)


def repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(id, sig, cuts): runs (start, count) of windows whose words also start in a document with a smaller id.

    ``docs``: id bigint, text string.
    """
    occ = materialize(occurrences(docs, window, kmer), "paths")
    repeated = materialize(occ.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a"), "anchors")
    hits = materialize(occ.join(repeated, "a", "left_semi"), "repeated-paths")
    classes = materialize(hits.groupBy(*KEY).agg(F.min(F.struct("id", "sig", "p0")).alias("src")), "classes")
    branching = materialize(classes.groupBy("a").count().where("count > 1").select("a"), "branching")

    spans = (classes.join(branching, "a", "left_semi").groupBy(F.col("src.id").alias("id"), F.col("src.sig").alias("sig"))
             .agg(F.collect_list(F.struct(*KEY, F.col("src.p0").alias("p0"))).alias("spans")))

    def windows(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text, spans_ in zip(*(b.column(c).to_pylist() for c in ("id", "text", "spans"))):
                h = word_hashes(words_of(text))
                at = np.concatenate([np.arange(s["p0"], s["p0"] + s["n"]) for s in spans_])
                count = [s["n"] for s in spans_]
                one, two = (span_hashes(h, at, at + window, base).view(np.int64) for base in (WORD_BASE, WORD_BASE_2))
                for col, v in zip(out, (np.repeat([s["a"] for s in spans_], count), np.repeat([s["ctx"] for s in spans_], count), np.repeat(count, count).astype(np.int32),
                                        np.concatenate([np.arange(c, dtype=np.int32) for c in count]), np.full(len(at), doc), one, two)):
                    col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "ctx", "n", "j", "low", "h1", "h2"])

    # rows that repeat are read once: each window of a class has one source
    once = _join_text(docs, spans, "inner").dropDuplicates(["id", "sig"])
    read = once.select("id", "text", "spans").mapInArrow(windows, "a bigint, ctx bigint, n int, j int, low bigint, h1 bigint, h2 bigint")
    read = materialize(read, "windows")
    low = materialize(read.groupBy("h1", "h2").agg(F.min("low").alias("m"), F.max("low").alias("x")).where("m < x").select("h1", "h2", "m"), "shared-windows")
    # of a class only windows that occur below its own lowest source need naming
    earlier = (read.join(low, ["h1", "h2"]).where("m < low").groupBy(*KEY)
               .agg(F.map_from_entries(F.collect_list(F.struct("j", "m"))).alias("earlier")))
    known = materialize(classes.select(*KEY, F.col("src.id").alias("low")).join(earlier, KEY, "left"), "class-sources")

    met = hits.join(known, KEY)
    from_low = F.when(F.col("low") < F.col("id"), F.array(F.struct(F.col("p0").alias("start"), F.col("n").alias("count"))))
    single = F.transform(F.map_keys("earlier"), lambda j: F.struct((F.col("p0") + j).alias("start"), F.lit(1).alias("count")))
    # a document above the class's lowest source loses all its windows; the lowest source itself those named
    cut = met.select("id", "sig", F.inline(F.coalesce(from_low, single)))
    return cut.groupBy("id", "sig").agg(F.collect_list(F.struct("start", "count")).alias("cuts"))


def cut_text(text: str | None, cuts, window: int = WINDOW) -> tuple[int, int, list[bytes], str | None]:
    """(words, removed words, kept words, text without the removed words); a text that loses nothing stays as it is."""
    words = words_of(text)
    n = len(words)
    if not cuts or not n:
        return n, 0, words, text
    d = np.zeros(n + 1, np.int64)
    start = np.array([c["start"] for c in cuts])
    count = np.array([c["count"] for c in cuts])
    np.add.at(d, start, 1)
    np.add.at(d, start + count - 1 + window, -1)
    gone = np.cumsum(d[:n]) > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    raw = np.frombuffer(text.encode(), np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    stays = np.flatnonzero(np.diff(np.concatenate(([0], (~gone).view(np.int8), [0]))))
    data = text.encode()
    rest = b" ".join(data[begin[a] : end[b - 1]] for a, b in zip(stays[::2], stays[1::2]))
    return n, int(gone.sum()), kept, rest.decode()


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def removal_report(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row.

    Null and empty texts have no words. Rows without an id are no source and lose nothing. Rows that repeat an
    id are one document for each other: they are no smaller source, and each loses what its own text repeats.
    """
    from hashlib import sha256

    plain = _plain(docs, id_col, text_col)

    def rows(batches):
        for b in batches:
            out = [cut_text(t, c, window)[:3] for t, c in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([sha256(b" ".join(o[2])).hexdigest() for o in out], pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    joined = _join_text(plain, repeats(plain, window, kmer), "left").select("id", "text", "cuts")
    return joined.mapInArrow(rows, f"{id_col} bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their columns, repeated words cut out of the text; a text that loses all its words becomes empty."""
    found = repeats(_plain(docs, id_col, text_col), window, kmer).withColumnRenamed("cuts", "c")
    names = {x: free_name(x, docs.columns) for x in ("id", "sig", "cuts")}
    keyed = docs.select("*", F.col(id_col).cast("bigint").alias(names["id"]), F.xxhash64(F.col(text_col).cast("string")).alias(names["sig"]))
    joined = keyed.join(found.select(F.col("id").alias(names["id"]), F.col("sig").alias(names["sig"]), F.col("c").alias(names["cuts"])), [names["id"], names["sig"]], "left")
    joined = joined.select(*docs.columns, names["cuts"])
    at = docs.columns.index(text_col)

    def rows(batches):
        for b in batches:
            texts = [cut_text(t, c, window)[3] for t, c in zip(b.column(at).to_pylist(), b.column(len(docs_columns)).to_pylist())]
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(rows, docs.schema)
