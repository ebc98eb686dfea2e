"""Language-model scores by prediction by partial matching.

A trie of byte contexts, counted over all occurrences in the training rows, gives the probability of every byte of every
text. A text is its words, a blank behind each and one end; contexts hold up to five bytes before, across words, and
begin with a blank before the text. A byte seen n times in the longest known context costs (2n - 1) / 2t of the context's
t; otherwise an escape of kinds / 2t leads to the context one byte shorter, where symbols of the longer one are excluded,
and so on down to an even choice among bytes never seen. So the probabilities of all texts add up to one.

The trie is a table of (order, context, byte, count). Frequent words and byte contexts are kept in tables of a fixed size
in the tasks; all others go through joins, so nothing unbounded is broadcast.
"""
from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.session import materialize

ORDER, BASE = 5, 257
HEAD_WORDS, FLUSH = 200_000, 200_000
HEAD_BYTES, CHUNK = 1 << 19, 1 << 20


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences in training rows; words of other rows come with 0."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return b

        for b in batches:
            for text, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (text or "").encode().lower().split()
                if train:
                    seen.update(words)
                else:
                    for w in words:
                        seen.setdefault(w, 0)
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    part = docs.select("text", "train").mapInArrow(run, "word binary, c bigint")
    return materialize(part.groupBy("word").agg(F.sum("c").alias("c")), "words")


def _log(x):
    return F.log10(x.cast("double"))


def _gram_costs(counted: DataFrame) -> DataFrame:
    """(gram, n, lp): log10 probability of the byte after its context, for every gram asked for."""
    cut = F.col("o")
    edges = counted.where("n > 0").select((F.col("gram") / 256).cast("bigint").alias("full"), (F.col("gram") % 256).cast("int").alias("s"), "n")
    powers = F.array(*[F.lit(BASE**o).cast("bigint") for o in range(ORDER + 1)])
    edges = materialize(edges.select("s", "n", "full", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("o"))
                        .select("o", F.pmod("full", F.get(powers, cut)).alias("ctx"), "s", "n").groupBy("o", "ctx", "s").agg(F.sum("n").alias("n")), "trie")
    # a context with totals of its own, and of what it excludes in the next shorter one
    shorter = edges.select((F.col("o") + 1).alias("o"), F.col("ctx").alias("up"), "s", F.col("n").alias("n_up"))
    known = edges.withColumn("up", F.pmod("ctx", F.get(powers, F.greatest(cut - 1, F.lit(0))))).join(shorter, ["o", "up", "s"], "left")
    nodes = materialize(known.groupBy("o", "ctx", "up").agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.coalesce(F.sum("n_up"), F.lit(0)).alias("gone")), "contexts")
    above = nodes.select((F.col("o") + 1).alias("o"), F.col("ctx").alias("up"), F.col("t").alias("t_up"), F.col("k").alias("k_up"))
    rest, kinds = F.col("t_up") - F.col("gone"), F.col("k_up") - F.col("k")
    nodes = nodes.join(above, ["o", "up"], "left").select(
        "o", "ctx", "k", _log(2 * F.col("t")).alias("whole"), (_log(F.col("k")) - _log(2 * F.col("t"))).alias("escape"),
        F.when(rest > 0, _log(2 * rest)).alias("rest"), F.when(kinds > 0, _log(kinds) - _log(2 * rest)).otherwise(0.0).alias("escape_up"))
    nodes = materialize(nodes, "escapes")

    full = counted.select("gram", "n", (F.col("gram") / 256).cast("bigint").alias("ctx"))
    seen = full.where("n > 0").join(nodes.where(F.col("o") == ORDER).select("ctx", "whole"), "ctx").select("gram", "n", (_log(2 * F.col("n") - 1) - F.col("whole")).alias("lp"))

    asked = full.where("n = 0").select("gram", (F.col("gram") % 256).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("o"), F.col("ctx").alias("full"))
    asked = asked.withColumn("ctx", F.pmod("full", F.get(powers, cut))).drop("full")
    # contexts of no or one byte are asked for by every gram, but there are at most 258 of them with 256 bytes each: they go to the rows
    low = F.col("o") <= 1
    few = asked.where(low).join(F.broadcast(nodes.where(low)), ["o", "ctx"], "left").join(F.broadcast(edges.where(low).select("o", "ctx", "s", "n")), ["o", "ctx", "s"], "left")
    found = asked.where(~low).join(nodes.where(~low), ["o", "ctx"], "left").join(edges.where(~low).select("o", "ctx", "s", "n"), ["o", "ctx", "s"], "left").unionByName(few)
    names = ("n", "k", "whole", "escape", "rest", "escape_up")
    wide = found.groupBy("gram").agg(*[F.max(F.when(cut == o, F.col(c))).alias(f"{c}_{o}") for o in range(ORDER + 1) for c in names])
    even = _log(256 - F.coalesce("k_0", F.lit(0)))
    lp = -even
    for top in range(ORDER + 1):  # the longest context that was seen
        cost = F.col(f"escape_{top}") + sum((F.col(f"escape_up_{o}") for o in range(1, top + 1)), F.lit(0.0)) - even
        for f in range(top):  # the longest one of them in which the byte was seen
            cost = F.when(F.col(f"n_{f}").isNotNull(), F.col(f"escape_{top}") + sum((F.col(f"escape_up_{o}") for o in range(f + 2, top + 1)), F.lit(0.0))
                          + _log(2 * F.col(f"n_{f}") - 1) - F.col(f"rest_{f + 1}")).otherwise(cost)
        cost = F.when(F.col(f"n_{top}").isNotNull(), _log(2 * F.col(f"n_{top}") - 1) - F.col(f"whole_{top}")).otherwise(cost)
        lp = F.when(F.col(f"k_{top}").isNotNull(), cost).otherwise(lp)
    return materialize(seen.unionByName(wide.select("gram", F.lit(0).cast("bigint").alias("n"), lp.alias("lp"))), "costs")


def _head(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most``, cut between eighths of powers of two."""
    bin_ = F.floor(F.log2(F.col(count).cast("double")) * 8)
    left, least = most, None
    for r in sorted(df.where(F.col(count) > 0).groupBy(bin_.alias("b")).count().collect(), key=lambda r: -r["b"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["b"]
    return df.where(F.col(count) > 0).where(bin_ >= least) if least is not None else df.limit(0)


def text_grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text index) of every byte of the texts' words, the blank behind each word and the end."""
    lines = [b" " + b"".join(w + b" " for w in words) + b"\n" for words in texts]
    line = np.frombuffer(b"".join(lines), np.uint8).astype(np.int64)
    size = np.array([len(x) for x in lines], np.int64)
    text = np.repeat(np.arange(len(lines)), size)
    place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    context = np.zeros(len(line), np.int64)
    for o in range(1, ORDER + 1):
        context[o:] += np.where(place[o:] >= o, line[:-o] + 1, 0) * BASE ** (o - 1)
    coded_ = place > 0
    return (context * 256 + line)[coded_], text[coded_]


def _chunks(batch: pa.RecordBatch):
    """(first row, words of each text) of pieces of about ``CHUNK`` bytes."""
    held, first, size = [], 0, 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        raw = (text or "").encode().lower()
        held.append(raw.split())
        size += len(raw)
        if size >= CHUNK:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def _count_text_grams(rows: DataFrame) -> DataFrame:
    """(gram, n): occurrences in training rows; grams of other rows come with 0."""
    def run(batches):
        kinds, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            g = np.concatenate([kinds, *(h[0] for h in held)])
            m = np.concatenate([n, *(h[1] for h in held)])
            held.clear()
            order = np.argsort(g, kind="stable")
            g, m = g[order], m[order]
            at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            return g[at], np.add.reduceat(m, at) if len(at) else m

        def out():
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["gram", "n"])

        for b in batches:
            train = b.column("train").to_numpy(zero_copy_only=False)
            for first, texts in _chunks(b):
                g, t = text_grams(texts)
                learned = train[first : first + len(texts)].astype(bool)[t]
                seen, times = np.unique(g[learned], return_counts=True)
                other = np.unique(g[~learned])
                held += [(seen, times.astype(np.int64)), (other, np.zeros(len(other), np.int64))]
                if sum(len(h[0]) for h in held) > CHUNK:
                    kinds, n = merged()
                    if len(kinds) > CHUNK:
                        yield out()
                        kinds, n = kinds[:0], n[:0]
        kinds, n = merged()
        if len(kinds):
            yield out()

    part = rows.select("text", "train").mapInArrow(run, "gram bigint, n bigint")
    return materialize(part.groupBy("gram").agg(F.sum("n").alias("n")), "text-grams")


def trie_score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row, learning from the rows where ``train`` holds.

    ``base_score``: add-one unigram model of the tokens; ``score``: log10 probability of the text's bytes under the trie. Null
    text counts as empty (one token, the end). Rows that repeat are scored each, also those without an id; where ``train`` is
    null a row is not learned from. Without training rows every byte costs log10(256).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_texts = rows.where("train").count()
    words = _count_words(rows)
    total = words.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (total["n"] or 0) + n_texts, (total["v"] or 0) + (n_texts > 0)
    costs = _gram_costs(_count_text_grams(rows))
    grams_ = _head(costs, "n", HEAD_BYTES).select("gram", "lp").toArrow().sort_by("gram")
    head = _head(words, "c", HEAD_WORDS).toArrow()
    frequent = {w: c for w, c in zip(head.column("word").to_pylist(), head.column("c").to_pylist())}
    shared = docs.sparkSession.sparkContext.broadcast((frequent, grams_.column("gram").to_numpy(), grams_.column("lp").to_numpy()))
    end_known, end_base = int(n_texts > 0), log10(n_texts + 1)

    def lists(values, per_text, kind):
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32()), pa.array(values, kind))

    def run(batches):
        counts, known, cost = shared.value
        for b in batches:
            for first, texts in _chunks(b):
                g, t = text_grams(texts)
                kinds, back = np.unique(g, return_inverse=True)
                at = np.minimum(np.searchsorted(known, kinds), max(0, len(known) - 1))
                hit = known[at] == kinds if len(known) else np.zeros(len(kinds), bool)
                lp = np.bincount(t, weights=np.where(hit, cost[at] if len(known) else 0.0, 0.0)[back], minlength=len(texts))
                left = ~hit[back]
                k, s, rest, times, per_text = [], [], [], [], []
                for all_words in texts:
                    known_, base, before = end_known, end_base, len(rest)
                    for w, tf in Counter(all_words).items():
                        c = counts.get(w)
                        if c is None:
                            rest.append(w)
                            times.append(tf)
                        else:
                            known_ += tf
                            base += tf * log10(c + 1)
                    k.append(known_)
                    s.append(base)
                    per_text.append(len(rest) - before)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(first, len(texts)), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.float64()), pa.array(lp),
                     lists(rest, per_text, pa.binary()), lists(times, per_text, pa.int32()), lists(g[left], np.bincount(t[left], minlength=len(texts)), pa.int64())],
                    names=["id", "n_tokens", "n_known", "base", "lp", "rest", "times", "grams"])

    part = rows.select("id", "text").mapInArrow(run, "id bigint, n_tokens bigint, n_known bigint, base double, lp double, rest array<binary>, times array<int>, grams array<bigint>")
    part = materialize(part.withColumn("row", F.monotonically_increasing_id()), "texts")
    rare = part.select("row", F.inline(F.arrays_zip(F.col("rest").alias("word"), F.col("times").alias("tf")))).join(words, "word")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("b"))
    spelled = part.select("row", F.explode("grams").alias("gram")).join(costs.select("gram", F.col("lp").alias("p")), "gram").groupBy("row").agg(F.sum("p").alias("p"))
    whole = log10(n + v + 1)
    return part.drop("rest", "times", "grams").join(more, "row", "left").join(spelled, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"), (F.col("lp") + F.coalesce("p", F.lit(0.0))).alias("score"))
