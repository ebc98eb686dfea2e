"""The prefix trie and the structure repair against brute force, on rows with every kind of edge."""
import itertools
import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwise.llm import prefixes, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, part int, depth int, kind string, block string, `cn` int"
EXTRA = ("x", 1, 2, "k", "b", 3)


def frame(spark, rows, parts=3):
    from pickwise.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


def some_conversations(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 205, 207, 305, -5, -103, 2**62, 2**62 + 1]:
        if c in (3, 100):
            continue  # conversation 100, a base, is absent
        turns = []
        for t in range(rng.choice([1, 2, 2, 3, 5, 7, 9])):
            turns.append((t, rng.choice(["user", "assistant", "system", "", None]), rng.choice(["a.", "b", "b!", "", None, " \t", "é 中.", "c" * 50])))
        if c % 9 == 4:
            turns = [(t, ("user", "assistant")[t % 2], "same.") for t in range(6)]
        if c % 17 == 2:
            turns += [(None, "user", "no number"), turns[0], turns[0], (40, "user", "later")]
        rows += [(c, *t) for t in turns]
    rows += [(150, t, "user", f"long {t}.") for t in range(300)]
    rng.shuffle(rows)
    return rows


def in_order(rows, fill):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t is not None, t or 0, fill if r is None else r, fill if x is None else x))
    return {c: sorted(v, key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode())) for c, v in out.items()}


def brute_trie(rows):
    convs = {c: [(r, x) for *_, r, x in v] for c, v in in_order([r for r in rows if r[0] is not None], "").items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100)) if abs(c) < 2**53 else c - c % 100
        rebuilt[c] = tuple(convs.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = {}
    for node, m in members.items():
        below = [k for k in members if k[: len(node)] == node]
        ends = sorted(c for c in m if len(rebuilt[c]) == len(node))
        out[node] = (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(k) == len(node) + 1 for k in below),
                     sum(not any(len(j) == len(k) + 1 and j[:-1] == k for j in below) for k in below),
                     sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("parts", ["1", "5"])
def test_trie(spark, parts, monkeypatch):
    rows = some_conversations()
    monkeypatch.setattr(prefixes, "NUMBERS", 3)
    monkeypatch.setattr(prefixes, "BLOCK", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(coalesce, "false")  # so that a conversation spans partitions
    try:
        got = prefixes.prefix_trie(frame(spark, rows + [(None, 1, "user", "no conversation")]))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(coalesce, "true")


def test_trie_empty_and_small(spark):
    assert prefixes.prefix_trie(frame(spark, []).limit(0)).count() == 0
    rows = [(7, None, None, None)]  # turnless when rebuilt if its head is longer than itself and its base is absent
    assert sorted((tuple(r) for r in prefixes.prefix_trie(frame(spark, rows, 1)).collect()), key=str) == brute_trie(rows)


def test_running_products():
    rng = np.random.default_rng(2)
    t, b = rng.integers(1, prefixes.PRIME, 40), prefixes.multipliers(0)[0]
    at = np.concatenate([np.arange(1), np.arange(30), np.arange(9)])
    h, q = prefixes.running(t.astype(np.uint64), at, b)
    want = 0
    for i in range(40):
        want = ((0 if at[i] == 0 else want) * b + int(t[i])) % prefixes.PRIME
        assert h[i] == want and q[i] == pow(b, int(at[i]) + 1, prefixes.PRIME)


def test_equal_fingerprints_of_other_turns_are_found(spark):
    """The comparison of neighbours tells keys that hold different turns from sound ones."""
    rows = [(1, 0, "user", "a"), (101, 0, "user", "b"), (201, 0, "user", "b")] + [(c, t, "user", f"x{c}") for c in (1, 101, 201) for t in range(1, 9)]
    stored = prefixes.stored_turns(frame(spark, rows).select("conv_id", "turn", "role", "text"))
    made = prefixes.rebuilt_prefixes(stored)

    def nodes(p):
        ref = "struct(r_conv, r_part, r_li)"
        return p.groupBy("depth", "k1", "k2").agg(F.expr(f"min({ref}) != max({ref})").alias("several"))

    flat = made.withColumn("k1", F.lit(0).cast("bigint")).withColumn("k2", F.lit(0).cast("bigint"))
    assert not prefixes.mismatches(stored, made, nodes(made))
    assert prefixes.mismatches(stored, flat, nodes(flat))


def brute_repair(turns):
    """Least (cost, audit, lines) over all edit scripts, by search over prefixes of the pattern."""
    blanks = " \t\n\x0b\x0c\r"
    seen, last, faults, rows = set(), None, [0, 0, 0, 0], []
    for n, t, r, x in turns:
        said = x.strip(blanks)
        must = cut = False
        if not said:
            faults[0], must = faults[0] + 1, True
        elif (r, x) in seen:
            faults[1], must = faults[1] + 1, True
        elif said[-1] not in ".!?":
            faults[2], cut = faults[2] + 1, True
        seen.add((r, x))
        if last is not None and last[:1] + r[:1] not in ("su", "ua", "au"):
            faults[3] += 1
        last = r
        rows.append((must, cut, r, x))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    states = {"": (0, "", ())}

    def better(d, k, v):
        if k not in d or v < d[k]:
            d[k] = v

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, e, ls) in list(out.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    if (s, i) in after:
                        better(out, after[s, i], (c + 5, e + "I", (*ls, f"{role}:")))
        return out

    for must, cut, r, x in rows:
        new = {}
        for s, (c, e, ls) in inserted(states).items():
            better(new, s, (c + 2, e + "D", ls))
            if not must:
                if (s, r[:1]) in after:
                    better(new, after[s, r[:1]], (c + 5 * cut, e + "K", (*ls, f"{r}:{x}")))
                for i, role in (("u", "user"), ("a", "assistant")):
                    if (s, i) in after:
                        better(new, after[s, i], (c + 1 + 5 * cut, e + "R", (*ls, f"{role}:{x}")))
        states = new
    cost, audit, lines = min(v for s, v in inserted(states).items() if s in ("", "a"))
    numbers = [t for n, t, *_ in turns if n]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *faults, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for c, t, r, x in rows:
        k = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 1:
            x = ""
        elif k == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        elif k == 4:
            r = "user"
        out += [] if k == 0 else [(c, t, r, x)] * (2 if k == 3 else 1)
    return out


@pytest.mark.parametrize("held", [repair.HELD, 3])
def test_repair(spark, held):
    rows = some_conversations(2, 300) + [(None, 0, "user", "a."), (None, 1, "assistant", "b.")]
    conversations = frame(spark, rows)
    left = in_order(damage(rows), " ")
    none = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    want = {c: brute_repair(left[c]) if c in left else none for c in {r[0] for r in rows}}
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(repair.damaged(conversations), conversations, held=held).collect()}
    assert {c: (got.get(c), w) for c, w in want.items() if got.get(c) != w} == {} and len(got) == len(want)


@pytest.mark.parametrize("held", [repair.HELD, 2])
def test_repaired_turns_have_the_reported_hash(spark, held):
    rows = some_conversations(3, 60)
    turns = repair.damaged(frame(spark, rows))
    said = {r["conv_id"]: r["repaired_sha256"] for r in repair.report(turns).collect()}
    texts = defaultdict(list)
    for r in repair.repaired(turns, held=held).orderBy("conv_id", "turn").collect():
        assert r["turn"] == len(texts[r["conv_id"]])
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: sha256("\n".join(texts[c]).encode()).hexdigest() for c in said} == said


def test_repair_finds_the_least_script():
    """The stepwise program against all scripts of short conversations."""
    texts = {"blank": " ", "cut": "x", "fine": "x."}
    for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=3):
        for kinds in itertools.product(texts, repeat=3):
            rows = [(True, i, r, texts[k] if k == "blank" else f"{i}{texts[k]}") for i, (r, k) in enumerate(zip(roles, kinds))]
            s = repair.Scan()
            for _, t, r, x in rows:
                s.add(t, r, x, False, False, None)
            cost, at, n = repair.last_step(s.costs, s.ranks)
            w = repair.Writer(False)
            for code, (r, x) in zip(repair.trace(bytes(s.pointers), at)[0], s.rows):
                w.row(code, r, x)
            w.end(n)
            assert (s.cost + cost, "".join(w.edits)) == brute_repair(rows)[5:7]


def test_repair_empty(spark):
    none = frame(spark, []).limit(0)
    assert repair.report(repair.damaged(none), none).count() == 0 and repair.repaired(none).count() == 0


def test_gaps_at_the_ends_of_bigint(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert repair.report(frame(spark, rows)).collect()[0]["gaps"] == 2**63 - 1
