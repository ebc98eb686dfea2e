"""Semi-structured text to typed columns: history, attributes, page context, model responses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import ColumnLike, INPUT_TYPE_VOCAB, col, strip, text, token_set, vocab_index

# The micro-formats of the input columns.
STEP_PATTERN = {
    "pipe": r"Step\s*\d+:\s*\[([^\]]+)\]\s*([^>]*?)\s*->\s*(\w+)(?::\s*([^|]+))?",
    "newline": r"Step\s+\d+:\s*\[([^\]]+)\]\s*(.*?)\s*->\s*(\w+)(?::\s*([^\n]*))?",
}
STEP_OP = r"->\s*(CLICK|TYPE|SELECT)"
STEP_MARK = r"Step \d+:"
ATTR_PAIR = r"(?:^|\s*\|\s*)([A-Za-z0-9_:-]+)\s*=\s*(.*?)(?=\s*\|\s*[A-Za-z0-9_:-]+\s*=|$)"
BEFORE_KEY = " \t\n\u000b\f\r|"
COMPLETED = r"(?i)Completed:\s*([^<\n]+)"
STEP_OF = r"(?i)step\s+(\d+)\s+of\s+(\d+)"
CURRENT_STEP_OF = r"(?i)current step\s+(\d+)\s+of\s+(\d+)"
PANEL = r'(?is)<section[^>]*aria-label="current workflow panel"[^>]*>(.*?)</section>'
NAME_ATTR = r'(?i)\bname="([^"]+)"'
HEADING = r"(?i)<h1[^>]*>([^<]+)</h1>"
ASIDE = r'(?i)<aside[^>]*class="workflow-context"[^>]*>([^<]+)</aside>'
INPUT_TYPE = r"(?i)\btype=([A-Za-z]+)"
SCRIPT_OR_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"

LABEL_CHAIN = ("aria-label", "placeholder", "title", "role", "label", "name")
EXAMPLE_LABEL_CHAIN = ("label", "aria-label", "placeholder", "name")
DESCRIPTION_CHAIN = ("aria-label", "placeholder", "label", "name")


def all_matches(c: ColumnLike, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


# ---------------------------------------------------------------- history

def history_steps(h: ColumnLike, sep: str = "pipe") -> Column:
    """array<struct<tag,text,op,value>>; `sep` says what ends a value."""
    p = STEP_PATTERN[sep]
    zipped = F.arrays_zip(*[all_matches(h, p, g).alias(n) for g, n in enumerate(("tag", "text", "op", "value"), 1)])
    return F.transform(zipped, lambda s: F.struct(*[strip(s[n]).alias(n) for n in ("tag", "text", "op", "value")]))


def last_step(steps: Column, field: str) -> Column:
    return F.coalesce(F.try_element_at(steps, F.lit(-1))[field], F.lit(""))


def joined_steps(steps: Column, field: str) -> Column:
    return F.array_join(F.transform(steps, lambda s: s[field]), " ")


def n_steps(h: ColumnLike) -> Column:
    return F.regexp_count(text(h), F.lit(STEP_MARK))


def history_signature(h: ColumnLike) -> Column:
    """Op sequence, STEP_n without ops, START without history."""
    ops = F.array_join(all_matches(h, STEP_OP), ",")
    return (F.when(strip(text(h)) == "", F.lit("START")).when(ops != "", ops)
            .otherwise(F.concat(F.lit("STEP_"), n_steps(h) + 1)))


def compress_history(h: ColumnLike, sep: str = "pipe") -> Column:
    """`[tag] text→OP:value` per step; text of another shape keeps its first 300 characters."""
    steps = history_steps(h, sep)

    def line(s: Column) -> Column:
        t, v = F.substring(s["text"], 1, 30), F.substring(s["value"], 1, 20)
        return F.concat(F.lit("["), s["tag"], F.lit("]"), F.when(t != "", F.concat(F.lit(" "), t)).otherwise(""),
                        F.lit("→"), s["op"],
                        F.when((v != "") & (s["op"] != "CLICK"), F.concat(F.lit(":"), v)).otherwise(""))

    return (F.when(strip(text(h)).isin("", "None", "nan"), F.lit("None"))
            .when(F.size(steps) > 0, F.array_join(F.transform(steps, line), " | "))
            .otherwise(F.substring(text(h), 1, 300)))


# ---------------------------------------------------------------- attributes

def attr_pairs(attrs: ColumnLike, normalise: bool = True) -> Column:
    """array<struct<k,v>> in text order; values may hold pipes up to the next `key=`.

    `aria_x` keys are read as `aria-x` unless `normalise` is off.
    """
    # taken as a whole, so that the pattern runs once: blanks and a pipe may stand before the key, the first `=` ends it
    cut = lambda m: F.struct(F.btrim(F.substring_index(m, "=", 1), F.lit(BEFORE_KEY)).alias("k"), F.substr(m, F.instr(m, F.lit("=")) + 1).alias("v"))
    pairs = F.transform(all_matches(strip(text(attrs)), ATTR_PAIR, 0), cut)

    def clean(p: Column) -> Column:
        k = F.when(p["k"].startswith("aria_"), F.replace(p["k"], F.lit("_"), F.lit("-"))).otherwise(p["k"]) if normalise else p["k"]
        return F.struct(k.alias("k"), strip(p["v"]).alias("v"))

    return F.transform(pairs, clean)


def pair(pairs: Column, key: str) -> Column:
    """Value of a key (the last one wins), '' when absent."""
    hit = F.filter(pairs, lambda p: p["k"] == key)
    return F.coalesce(F.try_element_at(hit, F.lit(-1))["v"], F.lit(""))


def attr(attrs: ColumnLike, key: str) -> Column:
    return pair(attr_pairs(attrs), key)


def first_attr(attrs: ColumnLike, key: str) -> Column:
    """First value of a key; the value ends at a pipe."""
    return strip(F.regexp_extract(text(attrs), rf"(?i)\b{key}=([^|]+?)(?=\s*\||$)", 1))


def split_options(opts: ColumnLike, sep: str = " / ") -> Column:
    """Option text to array, blanks dropped."""
    parts = F.transform(F.split(text(opts), sep.replace("/", "[/]")), lambda o: strip(o))
    return F.filter(parts, lambda o: o != "")


def options(attrs: ColumnLike, sep: str = " / ") -> Column:
    """`options=` of an attribute text as array."""
    raw = attr(attrs, "options") if sep == " / " else first_attr(attrs, "options")
    return split_options(raw, sep)


def first_filled(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def candidate_label(c: Column, chain: Sequence[str] = LABEL_CHAIN, lower: bool = True) -> Column:
    """Visible text or the first filled attribute of the chain; c is a candidate struct."""
    pairs = attr_pairs(c["attrs"])
    label = first_filled(strip(text(c["text"])), *[strip(pair(pairs, k)) for k in chain])
    return F.lower(label) if lower else label


def candidate_description(c: Column) -> Column:
    """Short sentence of a candidate for a relevance model."""
    pairs = attr_pairs(c["attrs"])
    label = first_filled(strip(text(c["text"])), *[pair(pairs, k) for k in DESCRIPTION_CHAIN])
    opts = pair(pairs, "options")
    return F.concat(strip(F.concat(text(c["tag"]), F.lit(" "), label)),
                    F.when(opts != "", F.concat(F.lit(" choices: "), F.substring(opts, 1, 60))).otherwise(""))


def input_type_index(attrs: ColumnLike) -> Column:
    return vocab_index(F.regexp_extract(text(attrs), INPUT_TYPE, 1), INPUT_TYPE_VOCAB)


# ---------------------------------------------------------------- page text

def html_type(html: ColumnLike) -> Column:
    h = text(html)
    return F.when(h.contains("workflow-context") | h.contains("completed-fields"), "workflow").otherwise("real_web")


def _split_lower(c: Column) -> Column:
    items = F.transform(F.split(c, ","), lambda x: F.lower(strip(x)))
    return F.filter(items, lambda x: x != "")


def html_context(html: ColumnLike) -> Column:
    """struct<completed,cur_step,tot_step,html_len,panel_names,h1_tokens,ctx_tokens>."""
    h = text(html)
    panel = F.regexp_extract(h, PANEL, 1)
    number = lambda g: F.coalesce(F.regexp_extract(h, STEP_OF, g).try_cast("int"), F.lit(0))
    return F.struct(
        F.array_distinct(_split_lower(F.array_join(all_matches(h, COMPLETED), ","))).alias("completed"),
        number(1).alias("cur_step"),
        number(2).alias("tot_step"),
        F.length(h).alias("html_len"),
        F.array_distinct(F.transform(all_matches(panel, NAME_ATTR), lambda n: F.lower(n))).alias("panel_names"),
        token_set(F.array_join(all_matches(h, HEADING), " ")).alias("h1_tokens"),
        token_set(F.array_join(all_matches(h, ASIDE), " ")).alias("ctx_tokens"),
    )


def workflow_status(html: ColumnLike) -> Column:
    """struct<current_step,total_steps,completed_fields> for prompts; first `Completed:` only."""
    h = text(html)
    items = F.transform(F.split(F.regexp_extract(h, r"(?i)Completed:\s*([^\n<]+)", 1), ","), lambda x: strip(x))
    return F.struct(
        F.regexp_extract(h, CURRENT_STEP_OF, 1).alias("current_step"),
        F.regexp_extract(h, CURRENT_STEP_OF, 2).alias("total_steps"),
        F.filter(items, lambda x: x != "").alias("completed_fields"),
    )


# ---------------------------------------------------------------- model responses

def parse_response(resp: ColumnLike, mode: str = "last") -> Column:
    """struct<op,choice,value> of a response text.

    last   the last brace block after the first `</think>` that is valid JSON
    first  the first brace block of the whole text
    greedy from the first to the last brace after the last `RESPONSE:`
    An unknown op or no JSON gives CLICK; CLICK has an empty value.
    """
    r = text(resp)
    if mode == "last":
        body = F.when(r.contains("</think>"), F.element_at(F.split(r, "</think>", 2), 2)).otherwise(r)
        blocks = F.filter(all_matches(body, r"\{[^{}]*\}", 0), lambda j: F.try_parse_json(j).isNotNull())
        block = F.try_element_at(blocks, F.lit(-1))
    elif mode == "first":
        block = F.regexp_extract(r, r"(?s)\{.*?\}", 0)
    elif mode == "greedy":
        body = F.element_at(F.split(r, "RESPONSE:"), -1)
        block = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # as the only entry of an array, so that text behind the object makes it invalid
    listed = F.concat(F.lit("["), block, F.lit("]"))
    fields = F.from_json(F.when(F.try_parse_json(listed).isNotNull(), listed), "array<struct<op:string,choice:string,value:string>>")
    js = F.when(F.size(fields) == 1, F.element_at(fields, 1))
    op = F.upper(F.coalesce(js["op"], F.lit("CLICK")))
    op = F.when(op.isin("CLICK", "TYPE", "SELECT"), op).otherwise("CLICK")
    return F.struct(
        op.alias("op"),
        F.coalesce(js["choice"], F.lit("")).alias("choice"),
        F.when(op == "CLICK", "").otherwise(F.coalesce(js["value"], F.lit(""))).alias("value"),
    )


def decode_choice(choice: ColumnLike, cands: ColumnLike) -> Column:
    """1-based choice number to candidate id; '' out of range or not a number."""
    n = col(choice).try_cast("int")
    return F.coalesce(F.when(n >= 1, F.try_element_at(col(cands), n)["candidate_id"]), F.lit(""))


def drop_script_style(html: ColumnLike) -> Column:
    return F.regexp_replace(text(html), SCRIPT_OR_STYLE, "")
