"""Conversation prefix trie by composable fingerprints.

A turn is the affine map x -> B*x + t over a prime field, t from a hash of role and text; a sequence of turns is the product
of its maps, (B**n, h), kept in four lanes of 31 bits. Products compose, so the fingerprint of a rebuilt conversation (head
of its base, then its own turns after the head) follows from the running products of both as stored: with P the own running
product, H that of the base's head and h its length, the own turn i gives (H - P(h)) * B**(i - h) + P(i). No rebuilt text is made.

Running products are taken over ranges: turns are sorted by (conversation, turn) into partitions of bounded size, each
partition keeps the products since its own start, and the few conversations that span partitions get the product of what lies
before. So a conversation with a third of all turns is spread over many tasks. Equal (depth, fingerprint) rows are a node.
That equal fingerprints mean equal turns is verified: the turns that the members of a node refer to are sorted by node
and neighbours are compared whole; after a mismatch everything is done again with other multipliers.
"""
from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pickwise.llm.common import prepare
from pickwise.session import materialize

PRIME, LANES, BASES, HEADS = (1 << 31) - 1, 4, 100, 6  # a conversation's base is id - id % BASES, its head has crc32(id) % HEADS turns
BLOCK, NUMBERS = 1024, 4096  # depths summed at a time; ids joined into one string
TRIES = 3


def multipliers(seed: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(100 + seed).integers(1 << 20, PRIME - 1, LANES)]


def turn_lanes(role: str, text: str) -> tuple[int, ...]:
    r = role.encode()
    d = blake2b(len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()
    return tuple(1 + int.from_bytes(d[4 * k : 4 * k + 4], "little") % (PRIME - 1) for k in range(LANES))


def running(t: np.ndarray, at: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of one lane up to each row since its segment's start, and the powers B ** (place in the segment); at: places from 0."""
    h, p = t.astype(np.uint64), np.uint64(PRIME)
    step, power, most = 1, b, int(at.max()) + 1 if len(at) else 0
    while step < most:
        far = np.flatnonzero(at >= step)
        before = h.copy()
        h[far] = (h[far] + before[far - step] * np.uint64(power)) % p
        step, power = 2 * step, power * power % PRIME
    q, bit, power = np.ones(len(at), np.uint64), 0, b
    e = at.astype(np.uint64) + np.uint64(1)
    while len(e) and int(e.max()) >> bit:
        odd = (e >> np.uint64(bit)) & np.uint64(1) == 1
        q[odd] = q[odd] * np.uint64(power) % p
        bit, power = bit + 1, power * power % PRIME
    return h, q


TURN = "conv_id bigint, part int, li bigint, role string, text string, chars bigint, " + ", ".join(f"{x}{k} bigint" for x in "thq" for k in range(LANES))


def _lanes(x: str) -> list[str]:
    return [f"{x}{k}" for k in range(LANES)]


def stored_turns(turns: DataFrame, seed: int = 0) -> DataFrame:
    """Turns in order, with the running products since the start of their range partition; input conv_id, turn, role, text."""
    mult = multipliers(seed)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        conv, n, h = None, 0, [0] * LANES  # the conversation carried over, its turns here so far and their product
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            start = np.zeros(len(ids), bool)
            start[0] = True
            start[1:] = ids[1:] != ids[:-1]
            first = np.flatnonzero(start)
            at = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
            goes_on = len(first) and conv == ids[0]
            ahead = int(first[1]) if len(first) > 1 else len(ids)
            t = np.array([turn_lanes(r, x) for r, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], np.uint64).reshape(-1, LANES)
            hs, qs = [], []
            for k in range(LANES):
                hk, qk = running(t[:, k], at, mult[k])
                if goes_on:  # (B**n, h) of the rows before, then these
                    hk[:ahead] = (hk[:ahead] + np.uint64(h[k]) * qk[:ahead]) % np.uint64(PRIME)
                    qk[:ahead] = qk[:ahead] * np.uint64(pow(mult[k], n, PRIME)) % np.uint64(PRIME)
                hs.append(hk)
                qs.append(qk)
            li = at + 1
            if goes_on:
                li[:ahead] += n
            conv, n, h = ids[-1], int(li[-1]), [int(x[-1]) for x in hs]
            cols = [pa.array(ids), pa.array(np.full(len(ids), part, np.int32)), pa.array(li), b.column(2), b.column(3), b.column(4)]
            cols += [pa.array(x.astype(np.int64)) for x in (*t.T, *hs, *qs)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [x.split()[0] for x in TURN.split(", ")]
    # equal rows can stand in any order; a random number lets them be spread
    spread = turns.withColumn("r", F.rand(1)).repartitionByRange("conv_id", "turn", "role", "text", "r").sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(spread.select("conv_id", "turn", "role", "text", F.char_length("text").cast("bigint").alias("chars")).mapInArrow(run, TURN), "turns")


def _carried(stored: DataFrame, mult: list[int]) -> DataFrame:
    """(conv_id, part, before, g0..): number and product of a conversation's turns in earlier partitions, for those that span several.

    At most two rows per partition, so the list is bounded by the number of partitions, not of turns.
    """
    last = stored.groupBy("conv_id", "part").agg(F.max(F.struct("li", *_lanes("h"))).alias("x")).select("conv_id", "part", "x.*")
    spans = materialize(last.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id"), "spanning")
    out, n, conv, g = [], 0, None, [0] * LANES
    for r in sorted(last.join(spans, "conv_id").collect()):
        if r["conv_id"] != conv:
            conv, n, g = r["conv_id"], 0, [0] * LANES
        out.append((conv, r["part"], n, *g, *[pow(m, n, PRIME) for m in mult]))
        g = [(x * pow(m, r["li"], PRIME) + r[f"h{k}"]) % PRIME for k, (x, m) in enumerate(zip(g, mult))]
        n += r["li"]
    return stored.sparkSession.createDataFrame(out, "conv_id bigint, part int, before bigint, " + ", ".join(f"{x} bigint" for x in _lanes("g") + _lanes("w")))


def rebuilt_prefixes(stored: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, ends, r_conv, r_part, r_li) for every prefix of every rebuilt conversation.

    k1, k2 hold the fingerprint's lanes, p1, p2 those of the prefix one turn shorter; r_* refer to the stored last turn. The
    textless prefix has depth 0 and key (0, 0).
    """
    mult = multipliers(seed)
    inverse = [pow(m, -1, PRIME) for m in mult]
    p = F.lit(PRIME).cast("bigint")

    def mod(x):
        return F.pmod(x, p)

    carried = F.broadcast(_carried(stored, mult))
    spots = stored.groupBy("conv_id", "part").agg(F.max("li").alias("n")).join(carried, ["conv_id", "part"], "left")
    spots = spots.select("conv_id", "part", "n", F.coalesce("before", F.lit(0)).alias("before"), *[F.coalesce(x, F.lit(0)).alias(x) for x in _lanes("g")], *[F.coalesce(x, F.lit(1)).alias(x) for x in _lanes("w")])
    spots = materialize(spots, "spots")
    # the first turns with their running products over the whole conversation
    early = stored.where(F.col("li") < HEADS).select("conv_id", "part", "li", "chars", *_lanes("t"), *_lanes("h"), *_lanes("q"))
    early = early.join(spots, ["conv_id", "part"]).withColumn("i", F.col("before") + F.col("li")).where(F.col("i") < HEADS)
    early = early.select("conv_id", "i", F.struct("chars", "part", "li", *_lanes("t"), *[mod(F.col(f"g{k}") * F.col(f"q{k}") + F.col(f"h{k}")).alias(f"h{k}") for k in range(LANES)]).alias("turn"))
    early = early.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "turn"))).alias("first"))  # at most five turns each
    convs = spots.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % BASES)
    heads = early.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    convs = convs.join(early, "conv_id").join(heads, "base", "left").withColumn("hb", F.least("h", F.when(F.col("head").isNotNull(), F.size("head")).otherwise(0).cast("bigint")))
    convs = convs.withColumn("len", F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs, "conversations")

    def packed(lanes):
        return [(lanes[0] * (1 << 31) + lanes[1]), (lanes[2] * (1 << 31) + lanes[3])]

    def keys(fp, t):
        up = [mod((f - x + p) * F.lit(i)) for f, x, i in zip(fp, t, inverse)]
        return [c.alias(n) for c, n in zip(packed(fp) + packed(up), ("k1", "k2", "p1", "p2"))]

    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", zero.alias("depth"), *[zero.alias(x) for x in ("k1", "k2", "p1", "p2", "chars")], (F.col("len") == 0).alias("ends"),
                        F.lit(None).cast("bigint").alias("r_conv"), F.lit(None).cast("int").alias("r_part"), F.lit(None).cast("bigint").alias("r_li"))
    some = convs.where("hb > 0").select("conv_id", "base", "len", F.explode(F.sequence(F.lit(1).cast("bigint"), "hb")).alias("depth"), "head")
    some = some.select("conv_id", "base", "len", "depth", F.col("head")[F.col("depth")].alias("x"))
    shared = some.select("conv_id", "depth", *keys([F.col(f"x.h{k}") for k in range(LANES)], [F.col(f"x.t{k}") for k in range(LANES)]), F.col("x.chars").alias("chars"),
                         (F.col("depth") == F.col("len")).alias("ends"), F.col("base").alias("r_conv"), F.col("x.part").alias("r_part"), F.col("x.li").alias("r_li"))

    # G: what a turn's product since its partition's start is continued from, for the rebuilt conversation
    powers = [[pow(i, e, PRIME) for e in range(HEADS)] for i in inverse]

    def from_head(k):
        h_base = F.coalesce(F.col("head")[F.col("hb")][f"h{k}"], zero)
        h_own = F.coalesce(F.col("first")[F.col("h")][f"h{k}"], zero)
        less = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in powers[k]]), (F.col("h") + 1).cast("int"))
        return mod((h_base - h_own + p) * less)

    own = convs.where("n > h").select("conv_id", "h", "hb", "len", *[from_head(k).alias(f"d{k}") for k in range(LANES)])
    own = spots.drop("n").join(own, "conv_id").select("conv_id", "part", "before", "h", "hb", "len", *[mod(mod(F.col(f"d{k}") * F.col(f"w{k}")) + F.col(f"g{k}")).alias(f"c{k}") for k in range(LANES)])
    mine = stored.drop("role", "text").join(own, ["conv_id", "part"]).withColumn("depth", F.col("before") + F.col("li") - F.col("h") + F.col("hb")).where("depth > hb")
    fp = [mod(F.col(f"c{k}") * F.col(f"q{k}") + F.col(f"h{k}")) for k in range(LANES)]
    mine = mine.select("conv_id", "depth", *keys(fp, [F.col(x) for x in _lanes("t")]), "chars", (F.col("depth") == F.col("len")).alias("ends"),
                       F.col("conv_id").alias("r_conv"), F.col("part").alias("r_part"), F.col("li").alias("r_li"))
    return materialize(root.unionByName(shared).unionByName(mine), "prefixes")


def mismatches(stored: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> bool:
    """Whether a node's members refer to last turns that differ. Turns go by node through a sort; neighbours are compared whole."""
    several = nodes.where("several").select("depth", "k1", "k2")
    refs = prefixes.where("depth > 0").join(several, ["depth", "k1", "k2"]).select("depth", "k1", "k2", "r_conv", "r_part", "r_li").distinct()
    refs = refs.withColumnsRenamed({"r_conv": "conv_id", "r_part": "part", "r_li": "li"})
    turns = stored.select("conv_id", "part", "li", "role", "text").join(refs, ["conv_id", "part", "li"]).select("depth", "k1", "k2", "conv_id", "li", "role", "text")
    keys = ["depth", "k1", "k2"]

    def run(batches):
        last, first, differ = None, None, False
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, "role", "text"))):
                if last is None:
                    first = row
                elif row[:3] == last[:3] and row != last:
                    differ = True
                last = row
        if last is not None:  # the partition's ends meet those of the others
            ends = [first, last] if last != first else [first]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends]) for i in range(3)] + [pa.array([sha256(repr(e[3:]).encode()).hexdigest() for e in ends]), pa.array([differ] * len(ends))],
                                             names=[*keys, "said", "differ"])

    ends = turns.repartitionByRange(*keys, "conv_id", "li").sortWithinPartitions(*keys).mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, said string, differ boolean")
    bad = ends.groupBy(*keys).agg((F.max("differ") | (F.min("said") != F.max("said"))).alias("bad")).where("bad")
    return not bad.isEmpty()


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): hash of the ids that end at a node, in order. Ids are joined in ranges first, so a node of very many ids is spread."""
    keys = ["depth", "k1", "k2"]
    schema = "depth bigint, k1 bigint, k2 bigint, conv_id bigint, ids string"

    def join(batches):
        key, ids = None, []
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if row[:3] != key or len(ids) == NUMBERS:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = row[:3], []
                ids.append(row[3])
            yield _rows(out, schema)
        if ids:
            yield _rows([(*key, ids[0], ",".join(map(str, ids)))], schema)

    def hashed(batches):
        key, h = None, None
        for b in batches:
            out = []
            for *k, _, ids in zip(*(b.column(i).to_pylist() for i in range(5))):
                if k != key:
                    if h:
                        out.append((*key, h.hexdigest()))
                    key, h = k, sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _rows(out, result)
        if h:
            yield _rows([(*key, h.hexdigest())], result)

    result = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    ends = prefixes.where("ends").select(*keys, "conv_id")
    parts = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(join, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(hashed, result)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = [(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in ddl.split(", "))]
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Turns stand in order of their number,
    null first, ties by role and text; rows that repeat are turns of their own. Null role or text counts as empty. Rows without a
    conversation id belong to none and are left out, as are other columns. An empty table has no conversation and gives no row.

    Sums over a subtree need no walk: a node's weight is put on its smallest member c, whose own nodes form the end of its
    path. So a node sums the weights of its smallest member from its depth on, and the whole weights of its other members.
    """
    prepare(conversations.sparkSession)
    turns = conversations.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                                 *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]).where("conv_id is not null")
    keys = ["depth", "k1", "k2"]
    for seed in range(TRIES):
        stored = stored_turns(turns, seed)
        prefixes = rebuilt_prefixes(stored, seed)
        ref = F.struct("r_conv", "r_part", "r_li")
        nodes = prefixes.groupBy(*keys).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("ends").alias("ended"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                            F.max("chars").alias("chars"), (F.min(ref) != F.max(ref)).alias("several"))
        nodes = materialize(nodes, "nodes")
        if not mismatches(stored, prefixes, nodes):
            break
    else:
        raise RuntimeError("turns with equal fingerprints differ under every set of multipliers")
    under = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(under, keys, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    nodes = nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("block", F.floor(F.col("depth") / BLOCK))
    nodes = materialize(nodes, "nodes-weighed")

    # weights of a representative from a depth on: sums of blocks of depths first, then inside a block
    blocks = nodes.groupBy("rep", "block").agg(F.sum("weight").alias("w"), F.sum("leaf").alias("l"), F.min("depth").alias("d"))
    later = Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select("rep", "block", "w", "l", "d", F.coalesce(F.sum("w").over(later), F.lit(0)).alias("w_later"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l_later")), "weight-blocks")
    inside = Window.partitionBy("rep", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.join(blocks.select("rep", "block", "w_later", "l_later"), ["rep", "block"])
    nodes = nodes.select(*keys, "rep", "n_convs", "n_children", "p1", "p2", (F.sum("weight").over(inside) + F.col("w_later")).alias("w_from"), (F.sum("leaf").over(inside) + F.col("l_later")).alias("l_from"))
    nodes = materialize(nodes, "nodes-summed")
    whole = blocks.groupBy("rep").agg(F.sum("w").alias("w"), F.sum("l").alias("l"), F.min("d").alias("own")).where("w > 0 or l > 0")
    # every member that is not the smallest brings all it stands for; blocks keep the rows of one join key few
    whole = whole.where("own > 0").select(F.col("rep").alias("conv_id"), "w", "l", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("own") - 1) / BLOCK))).alias("block"))
    brought = prefixes.withColumn("block", F.floor(F.col("depth") / BLOCK)).join(whole, ["conv_id", "block"]).where("depth < own").groupBy(*keys).agg(F.sum("w").alias("w_more"), F.sum("l").alias("l_more"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    above = nodes.where("depth > 0").select(*keys, "p1", "p2").join(parents, ["depth", "p1", "p2"]).select(*keys, "parent_conv_id")
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = nodes.join(above, keys, "left").join(brought, keys, "left").join(end_hashes(prefixes), keys, "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l_from") + F.coalesce("l_more", F.lit(0))).alias("n_leaves"),
                      (F.col("w_from") + F.coalesce("w_more", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
