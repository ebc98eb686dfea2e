"""Quotation linking: replies are tied to the messages they quote, and quotes are taken out.

Lines that begin with '>' marks are parsed into passages by nested level. A passage is normalised (marks off, white
space collapsed, lower case) and hashed; unquoted passages and lines of all messages are the originals. A
quotation is joined to the first message of its thread that holds its passage, or else to the first message at all that
does, so a passage shared by very many messages still gives one row per quotation. A level-2 passage inside a
quoted level-1 passage says the same of the quoted message.

One order holds for everything: (order, thread), null before all numbers. A message answers only messages that stand
strictly before it, so links never form a cycle and don't depend on how the rows are stored. Chains of replies are
followed by pointer doubling; messages whose root is found leave the rounds.
"""
from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from pickwise.llm.common import text_map
from pickwise.session import materialize

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"^(?:On .{1,200} wrote|.{1,120} (?:wrote|said)):[ \t]*$")


def passages(text: str | None) -> list[tuple[int, list[str]]]:
    """(level, lines without marks) of the runs of lines with one quote level; level 0 is the message's own."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line) if ">" in line else None
        level = m[1].count(">") if m else 0
        body = line[m.end():] if m else line
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(body)
    return out


def _own(runs: list[tuple[int, list[str]]]) -> str:
    kept: list[str] = []
    for k, (level, lines) in enumerate(runs):
        if level == 0:
            introduces = k + 1 < len(runs) and lines and _ATTRIBUTION.match(lines[-1])
            kept += lines[:-1] if introduces else lines
    return "\n".join(kept).strip("\n")


def own_text(text: str | None) -> str:
    """The text without quotations and without the line that introduces one."""
    return _own(passages(text))


def digest(s: str) -> str | None:
    """Hash of a normalised passage; None if nothing is left."""
    s = " ".join(s.split()).lower()
    return sha256(s.encode()).hexdigest()[:32] if s else None


def parse(messages: DataFrame) -> DataFrame:
    """(key, level, seq, h, whole) of every passage and of every line in it; messages: key bigint, text."""
    def rows(text):
        runs = passages(text)
        for seq, (level, lines) in enumerate(runs):
            if level == 0 and lines and _ATTRIBUTION.match(lines[-1]):
                lines = lines[:-1]
            h = digest("\n".join(lines))
            if h:
                yield level, seq, h, True
                if len(lines) > 1:
                    for g in {digest(x) for x in lines} - {None, h}:
                        yield level, seq, g, False
        own = digest(_own(runs))
        if own:
            yield 0, -1, own, True

    return text_map(messages, "level int, seq int, h string, whole boolean", rows, "key", "text")


PLACE = ("numbered", "at", "threaded", "thread")  # the order of messages
WHO = (*PLACE, "sig", "key")  # of messages at one place: by their text, then any


def _before(a: str, b: str):
    """Whether message a stands before message b; both are prefixes of the columns of PLACE."""
    return F.struct(*[F.col(a + c) for c in PLACE]) < F.struct(*[F.col(b + c) for c in PLACE])


def linked(messages: DataFrame, thread_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(thread, order, key, reply_to, root, depth, text) for every message.

    reply_to and root are keys (the message itself is the root if it quotes nothing known); depth counts replies up to
    the root; text is without quotes. Null and empty texts quote nothing. A message answers only messages before it by
    (order, thread), null first; messages at the same place, rows that repeat among them, don't answer each other, and
    all of them answer alike what they quote. Rows without a thread are quoted from anywhere, but share no thread.
    Other columns are left out.
    """
    base = messages.select(F.col(thread_col).cast("bigint").alias("t"), F.col(order_col).cast("bigint").alias("o"), F.col(text_col).cast("string").alias("text"))
    base = base.select("t", "o", "text", F.col("o").isNotNull().alias("numbered"), F.coalesce("o", F.lit(0)).alias("at"), F.col("t").isNotNull().alias("threaded"),
                       F.coalesce("t", F.lit(0)).alias("thread"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sig"), F.monotonically_increasing_id().alias("key"))
    base = materialize(base, "messages")
    place = base.select(*WHO)
    found = materialize(parse(base.select("key", "text")).join(place, "key"), "passages")

    first = F.min(F.struct(*WHO)).alias("src")
    originals = found.where("level = 0")
    in_thread = materialize(originals.where("threaded").groupBy("thread", "h").agg(first).withColumn("threaded", F.lit(True)), "originals")
    anywhere = materialize(originals.groupBy("h").agg(first.alias("any")), "originals")
    quotes = found.where("level > 0")
    q = quotes.join(in_thread, ["threaded", "thread", "h"], "left").join(anywhere, "h", "left")
    near = F.when(_before("src.", ""), F.col("src"))
    q = q.select("key", "level", "seq", "whole", near.alias("near"), F.when(_before("any.", ""), F.col("any")).alias("far"))
    # a whole passage before a line of it, a passage of the thread before one from elsewhere
    rank = F.struct((~F.col("whole")).alias("part"), F.col("near").isNull().alias("elsewhere"), F.coalesce("near", "far").alias("to"))
    run = materialize(q.where("near is not null or far is not null").groupBy("key", "level", "seq").agg(F.min(rank).alias("r")).select("key", "level", "seq", F.col("r.to").alias("to")), "quotations")
    own = run.where("level = 1").groupBy("key").agg(F.min(F.struct("seq", "to")).alias("x")).select("key", F.col("x.to.key").alias("reply_to"))
    # the passage one level deeper next to a quotation is what the quoted message answers
    deeper = run.select("key", (F.col("level") - 1).alias("level"), F.explode(F.array(F.col("seq") - 1, F.col("seq") + 1)).alias("seq"), F.col("to").alias("under"))
    said = run.join(deeper, ["key", "level", "seq"]).where(_before("under.", "to.")).groupBy(F.col("to.key").alias("key")).agg(F.min("under").alias("u")).select("key", F.col("u.key").alias("implied"))
    parents = place.select("key").join(own, "key", "left").join(said, "key", "left").select("key", F.coalesce("reply_to", "implied").alias("reply_to"))

    up = materialize(parents.select("key", "reply_to", F.coalesce("reply_to", "key").alias("root"), F.col("reply_to").isNotNull().cast("bigint").alias("depth"), F.col("reply_to").isNull().alias("found")), "replies")
    for _ in range(64):  # links lead strictly backwards, and paths double
        if up.where("not found").isEmpty():
            break
        hop = up.select(F.col("key").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("found").alias("last"))
        moved = up.where("not found").join(hop, "root").select("key", "reply_to", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("last").alias("found"))
        up = materialize(up.where("found").unionByName(moved), "replies")
    plain = text_map(base.select("key", "text"), "text string", lambda t: [(own_text(t),)], "key", "text")
    out = base.select("key", "t", "o").join(up, "key").join(plain, "key")
    return out.select(F.col("t").alias(thread_col), F.col("o").alias(order_col), "key", "reply_to", "root", "depth", "text")


def conversations(links: DataFrame, thread_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Messages with the place of what they answer: (thread, order, reply_thread, reply_order, root_thread, root_order, depth, text).

    Sorted by root, depth and order, a conversation reads with every answer behind what it answers.
    """
    spot = links.select("key", F.col(thread_col).alias("t"), F.col(order_col).alias("o"))
    # messages that answer nothing, of which there may be very many, need no join: they are their own root
    alone = links.where("reply_to is null")
    alone = alone.select(thread_col, order_col, *[F.lit(None).cast(links.schema[c].dataType).alias(n) for c, n in ((thread_col, "reply_thread"), (order_col, "reply_order"))],
                         F.col(thread_col).alias("root_thread"), F.col(order_col).alias("root_order"), "depth", "text")
    to = spot.select(F.col("key").alias("reply_to"), F.col("t").alias("reply_thread"), F.col("o").alias("reply_order"))
    root = spot.select(F.col("key").alias("root"), F.col("t").alias("root_thread"), F.col("o").alias("root_order"))
    answers = links.where("reply_to is not null").join(to, "reply_to").join(root, "root")
    return answers.select(*alone.columns).unionByName(alone)


def quoting(messages: DataFrame, thread_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", reach: int = 2) -> DataFrame:
    """Mail form of a thread: every message under quotes of up to ``reach`` messages before it, nested by distance."""
    from pyspark.sql import Window

    w = Window.partitionBy(thread_col).orderBy(order_col)
    body = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for d in range(reach, 0, -1):
        mark = "> " * d
        before = F.lag(text_col, d).over(w)
        parts.append(F.when(before.isNotNull(), F.concat(F.regexp_replace(before, r"(?m)^", mark), F.lit("\n"))).otherwise(F.lit("")))
    return messages.select(thread_col, order_col, F.concat(*parts, body).alias(text_col))
