"""Conversation structure repair: the cheapest edits that give a conversation the roles (system)? (user assistant)+.

Turns are dealt by conversation and sorted by turn; one pass carries the state of a dynamic program over the Arrow batches: for
each of the four places in the wanted pattern the cheapest cost so far and the rank of its edit string. Ranks are enough to
break ties by the least edit string, because the strings that stand for the four places after a row differ before they end.

A conversation of moderate size is traced back when its last row has passed. One beyond HELD rows or HELD_CHARS characters
is spilled: its rows and the back pointers, four bytes a row, leave the task as rows of a table in blocks. The blocks are then
followed from the last to the first, and the rows meet their edits in order once more. So no task holds more than a block.
"""
from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pickwise.llm.common import prepare
from pickwise.session import materialize

HELD, HELD_CHARS = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
BLANKS, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)  # what the roles so far end in
NEVER = 1 << 60
OPS = "KRD"
# how a place is entered before a row: (place before, inserted turns)
ENTRY = {START: [(START, 0)], SYSTEM: [(SYSTEM, 0)], USER: [(USER, 0), (START, 1), (SYSTEM, 1), (ASSISTANT, 1)], ASSISTANT: [(ASSISTANT, 0), (USER, 1), (START, 2), (SYSTEM, 2)]}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
MOST = (1 << 63) - 1


@lru_cache(maxsize=None)
def moves(kind: str, truncated: bool) -> list[list[tuple]]:
    """Per place after a row, (place before, cost, edits, code) of the ways there. kind: the role's initial, or 'd' for a row that must go."""
    out: list[list[tuple]] = [[] for _ in range(4)]
    for at, ways in ENTRY.items():
        steps = [("D", at, DELETE)]
        if kind != "d":
            extra = TRUNCATED if truncated else 0
            steps += [("K", to, KEEP + extra) for f, to in KEPT.get(kind, {}).items() if f == at] + [("R", REROLED[at], REROLE + extra)]
        for op, to, cost in steps:
            for before, n in ways:
                out[to].append((before, cost + n * INSERT, "I" * n + op, before | n << 2 | OPS.index(op) << 4))
    return out


@lru_cache(maxsize=1 << 16)
def step(costs: tuple, ranks: tuple, kind: str, truncated: bool) -> tuple[int, tuple, tuple, bytes]:
    """(least cost, costs above it, ranks, back pointers) after a row."""
    best = []
    for ways in moves(kind, truncated):
        found = [(costs[b] + c, ranks[b], edits, code) for b, c, edits, code in ways if costs[b] < NEVER]
        best.append(min(found) if found else None)
    least = min(x[0] for x in best if x)
    order = sorted((x[1], x[2], at) for at, x in enumerate(best) if x)
    place = {at: r for r, (_, _, at) in enumerate(order)}
    return (least, tuple(x[0] - least if x else NEVER for x in best), tuple(place.get(at, 0) for at in range(4)), bytes(x[3] if x else 255 for x in best))


def last_step(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """(cost, place, inserted turns) of the best end."""
    ends = [(costs[START], ranks[START], "", START, 0)] + [(costs[b] + n * INSERT, ranks[b], "I" * n, b, n) for b, n in ENTRY[ASSISTANT]]
    cost, _, _, at, n = min(e for e in ends if e[0] < NEVER)
    return cost, at, n


def trace(pointers: bytes, at: int) -> tuple[bytes, int]:
    """Codes of a block's rows, in order, and the place before the block, from the place after it."""
    codes = bytearray(len(pointers) // 4)
    for i in range(len(codes) - 1, -1, -1):
        codes[i] = pointers[4 * i + at]
        at = codes[i] & 3
    return bytes(codes), at


class Writer:
    """Roles and texts of a repaired conversation, in order, from rows and codes."""

    def __init__(self, turns: bool):
        self.at, self.edits, self.hash, self.turns, self.empty = START, [], sha256(), [] if turns else None, True

    def put(self, role: str, text: str) -> None:
        self.at = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
        if self.turns is not None:
            self.turns.append((role, text))
        self.hash.update((b"" if self.empty else b"\n") + f"{role}:{text}".encode())
        self.empty = False

    def next_role(self) -> str:
        return "assistant" if self.at == USER else "user"

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.put(self.next_role(), "")

    def row(self, code: int, role: str, text: str) -> None:
        n, op = code >> 2 & 3, OPS[code >> 4]
        self.insert(n)
        self.edits.append("I" * n + op)
        if op != "D":
            self.put(role if op == "K" else self.next_role(), text)

    def end(self, n: int) -> None:
        self.insert(n)
        self.edits.append("I" * n)


class Scan:
    """State of one conversation while its rows pass."""

    def __init__(self):
        self.costs, self.ranks, self.cost = (0, NEVER, NEVER, NEVER), (0, 0, 0, 0), 0
        self.rows, self.pointers, self.chars, self.block, self.n = [], bytearray(), 0, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, role: str, text: str, repeat: bool, first_null: bool, first: int | None) -> None:
        """repeat: its role and text stand more than once, first at ``first``."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        said = text.rstrip(BLANKS)
        again = repeat and (self.last == (turn, role, text) or (turn is not None and (first_null or turn > first)))
        must, cut = False, False
        if not said:
            self.blank, must = self.blank + 1, True
        elif again:
            self.duplicate, must = self.duplicate + 1, True
        elif said[-1] not in ENDS:
            self.truncated, cut = self.truncated + 1, True
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        more, self.costs, self.ranks, pointers = step(self.costs, self.ranks, "d" if must else role[:1] if role[:1] in KEPT else "", cut)
        self.cost += more
        self.pointers += pointers
        self.rows.append((role, text))
        self.chars += len(text)
        self.last, self.n = (turn, role, text), self.n + 1

    def counts(self) -> tuple:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.distinct)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


ROW = "kind int, cn boolean, conv bigint, block bigint, idx bigint, role string, text string, data binary, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
REPORT, POINTERS, SPILLED, SUMMARY, TURN = range(5)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _results(key: dict, w: Writer, counts: dict) -> list[dict]:
    if w.turns is not None:
        out = [key | {"kind": TURN, "idx": i, "role": r, "text": t} for i, (r, t) in enumerate(w.turns)]
        return out
    return [key | counts | {"kind": REPORT, "audit": "".join(w.edits), "repaired_sha256": w.hash.hexdigest()}]


def _run(rows: DataFrame, turns: bool, held: int, held_chars: int) -> DataFrame:
    """Rows of kind REPORT (or TURN) for every conversation that has rows."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(T._parse_datatype_string(ROW))

    def scan(batches):
        key, s, out = None, None, []

        def spill():
            out.append(key | {"kind": POINTERS, "block": s.block, "data": bytes(s.pointers)})
            out.extend(key | {"kind": SPILLED, "block": s.block, "idx": i, "role": r, "text": t} for i, (r, t) in enumerate(s.rows))
            s.rows, s.pointers, s.chars, s.block = [], bytearray(), 0, s.block + 1

        def close():
            cost, at, n = last_step(s.costs, s.ranks)
            counts = dict(zip(COUNTS, (*s.counts(), s.cost + cost)))
            if s.block:
                spill()
                out.append(key | counts | {"kind": SUMMARY, "block": MOST, "idx": at | n << 2})
                return
            w = Writer(turns)
            for code, (role, text) in zip(trace(bytes(s.pointers), at)[0], s.rows):
                w.row(code, role, text)
            w.end(n)
            out.extend(_results(key, w, counts))

        for b in batches:
            for cn, conv, *row in zip(*(b.column(i).to_pylist() for i in range(8))):
                if key is None or (key["cn"], key["conv"]) != (cn, conv):
                    if key is not None:
                        close()
                    key, s = {"cn": cn, "conv": conv}, Scan()
                s.add(*row)
                if len(s.rows) >= held or s.chars >= held_chars:
                    spill()
            yield _batch(out, schema)
            out.clear()
        if key is not None:
            close()
            yield _batch(out, schema)

    by = ["cn", "conv"]
    found = rows.repartition(*by).sortWithinPartitions(*by, "turn", "role", "text").mapInArrow(scan, ROW)
    found = materialize(found, "repair")
    if found.where(F.col("kind") == SUMMARY).isEmpty():
        return found

    def back(batches):
        at, out = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == SUMMARY:
                    at = r["idx"] & 3
                else:
                    codes, at = trace(r["data"], at)
                    out.append(r | {"idx": -1, "data": codes})
            yield _batch(out, schema)
            out = []

    def forth(batches):
        w, codes, out = None, b"", []
        for b in batches:
            for r in b.to_pylist():
                key = {"cn": r["cn"], "conv": r["conv"]}
                if r["kind"] == POINTERS:
                    w, codes = w or Writer(turns), r["data"]
                    if turns and r["block"] == 0:
                        sent = 0
                elif r["kind"] == SPILLED:
                    w.row(codes[r["idx"]], r["role"], r["text"])
                else:
                    w.end(r["idx"] >> 2)
                if turns:
                    out += [key | {"kind": TURN, "idx": sent + i, "role": x, "text": t} for i, (x, t) in enumerate(w.turns)]
                    sent += len(w.turns)
                    w.turns.clear()
                    w.edits.clear()
                if r["kind"] == SUMMARY:
                    if not turns:
                        out += _results(key, w, {c: r[c] for c in COUNTS})
                    w = None
            yield _batch(out, schema)
            out = []

    pointers = found.where(F.col("kind").isin(POINTERS, SUMMARY)).repartition(*by).sortWithinPartitions(*by, F.desc("block")).mapInArrow(back, ROW)
    spilled = materialize(pointers, "repair-edits").unionByName(found.where(F.col("kind").isin(SPILLED, SUMMARY)))
    large = spilled.repartition(*by).sortWithinPartitions(*by, "block", "idx").mapInArrow(forth, ROW)
    return found.where(F.col("kind").isin(REPORT, TURN)).unionByName(large)


def _keyed(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with what is known of earlier ones with the same role and text. Null role or text: one space."""
    t = turns.select(F.col(id_col).isNull().alias("cn"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                     *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    t = t.withColumn("said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("first")
    repeats = t.groupBy("cn", "conv", "said").agg(F.count("*").alias("n"), first).where("n > 1")
    t = t.join(repeats, ["cn", "conv", "said"], "left")
    return t.select("cn", "conv", "turn", "role", "text", F.col("n").isNotNull().alias("repeat"), F.coalesce(~F.col("first.numbered"), F.lit(False)).alias("first_null"), F.col("first.turn").alias("first"))


def report(turns: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           held: int = HELD, held_chars: int = HELD_CHARS) -> DataFrame:
    """Faults and cheapest repair of every conversation, also of those that only ``ids`` names.

    (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Turns stand in order of their number, null
    first, ties by role and text. A null role or text counts as one space. Rows without a conversation id form one conversation with
    a null id. A conversation without rows has zeros, an empty audit and the hash of nothing. gaps ends at the largest bigint.
    Other columns are left out.
    """
    prepare(turns.sparkSession)
    found = _run(_keyed(turns, id_col, turn_col, role_col, text_col), False, held, held_chars).where(F.col("kind") == REPORT)
    found = found.select("cn", "conv", *COUNTS, "audit", "repaired_sha256")
    rows = (ids if ids is not None else turns).select(F.col(id_col).isNull().alias("cn"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("conv")).distinct()
    out = rows.join(found, ["cn", "conv"], "left")
    return out.select(F.when(~F.col("cn"), F.col("conv")).alias(id_col), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held: int = HELD, held_chars: int = HELD_CHARS) -> DataFrame:
    """The turns of the repaired conversations: (id, turn from 0, role, text). Conversations that lose every turn have none; else as ``report``."""
    prepare(turns.sparkSession)
    found = _run(_keyed(turns, id_col, turn_col, role_col, text_col), True, held, held_chars).where(F.col("kind") == TURN)
    return found.select(F.when(~F.col("cn"), F.col("conv")).alias(id_col), F.col("idx").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults put in by crc32 of "id:turn" modulo 20: 0 drops, 1 empties, 2 takes out sentence ends, 3 repeats, 4 makes it the user's. A null is one space."""
    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(id_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
