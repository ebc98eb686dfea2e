"""Rule extraction, the consistency guard and its audit. Everything stays inside the row."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as ps, text as tx
from ..session import pin
from ..sources.schema import OPS
from .rows import candidate_of, mapped

# Tag groups, verbs and value patterns of the task language.
TAG_TO_OP = {"input": "TYPE", "textarea": "TYPE", "select": "SELECT", "button": "CLICK", "a": "CLICK", "link": "CLICK"}
TAG_TO_OP_CHECK = TAG_TO_OP | {"checkbox": "CHECK", "radio": "CHECK"}
POOL = {"TYPE": ("input", "textarea"), "SELECT": ("select",), "CLICK": ("button", "a")}
TYPE_VERBS = r"\btype\b|\benter\b|\binput\b|fill(?:\s+in)?\b|write\b"
SELECT_VERBS = r"\bselect\b|\bchoose\b|\bpick\b|\bset\b"
QUOTED = r"""["']([^"']+)["']"""
QUOTED_ANY = r"""["'“”‘’]([^"'“”‘’]{1,80})["'“”‘’]"""
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
MONTH_DAY = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s*\d+\b"
NUMBER = r"\b\d+\b"
CAPITALISED = r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
DATES = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}",
)
LABEL_ATTRS = r"(?i)(label|name|placeholder)=([^|]+?)(?=\s*\||$)"
AFTER_LABEL = r"\b\s*[:]?\s*([^,\.\n]+)"
AFTER_FIELD = r"\s*(?:is|as|to|:|-)??\s*([^,.;\n]+)"
VALUE_TAIL = r"(?i)\s+(and|with|for|to|then)\b.*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column, chars: str = tx.WHITE) -> Column:
    return F.btrim(c, F.lit(chars))


def quote(c: Column) -> Column:
    """Literal regex text."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def extract_dynamic(c: Column, pattern: Column) -> Column:
    """First group of a pattern that differs per row."""
    return F.call_function("regexp_extract", c, pattern, F.lit(1))


def first_of(values: Column, keep: Callable[[Column], Column] = lambda x: x != "") -> Column:
    return F.coalesce(F.try_element_at(F.filter(values, keep), F.lit(1)), F.lit(""))


# ---------------------------------------------------------------- op rules

def op_from_tag(tag: Column, check: bool = False) -> Column:
    return mapped(F.lower(tx.text(tag)), TAG_TO_OP_CHECK if check else TAG_TO_OP, "CLICK")


def op_from_task(task: Column) -> Column:
    t = F.lower(tx.text(task))
    return F.when(t.rlike(TYPE_VERBS), "TYPE").when(t.rlike(SELECT_VERBS), "SELECT").otherwise("CLICK")


# ---------------------------------------------------------------- candidate fields and scores

def candidate_fields(c: Column) -> Column:
    """Candidate with its attributes parsed once."""
    return let(ps.attr_pairs(c["attrs"]), lambda p: F.struct(
        tx.text(c["candidate_id"]).alias("candidate_id"), F.lower(tx.text(c["tag"])).alias("tag"), tx.text(c["text"]).alias("text"),
        tx.text(c["attrs"]).alias("attrs"), *[ps.pair(p, k).alias(n) for n, k in (
            ("label", "label"), ("placeholder", "placeholder"), ("aria", "aria-label"), ("name", "name"), ("type", "type"))],
        ps.split_options(ps.pair(p, "options")).alias("opts")))


def with_fields(df: DataFrame) -> DataFrame:
    """Adds `cf`: the candidate array with parsed fields, and the task's words `tw` and lower case `tl`."""
    d = (df.withColumn("cf", F.transform("cands", candidate_fields))
         .withColumn("tl", F.lower(tx.text("task"))).withColumn("tw", tx.word_set("task")))
    return pin(d, "cf", "tl", "tw")


def match_score(f: Column, task_lower: Column, task_words: Column) -> Column:
    """Field words longer than 2 found inside the task, plus the share of field words among the task's words."""
    words = tx.word_list(F.concat_ws(" ", f["text"], f["label"], f["placeholder"], f["aria"], f["name"]))

    def score(w: Column) -> Column:
        hits = F.size(F.filter(w, lambda x: (F.length(x) > 2) & F.contains(task_lower, x)))
        return hits + let(F.array_distinct(w), lambda d: tx.ratio(tx.common(d, task_words), F.size(d)))

    return let(words, score)


def option_score(o: Column, words: Column) -> Column:
    return let(tx.word_set(o), lambda w: tx.common(w, words) / F.greatest(F.size(w), F.lit(1)))


def relevance_score(f: Column, task_lower: Column, task_words: Column, op: Column) -> Column:
    """Match score with a bonus for tags that suit the op and for options the task mentions."""
    tag_bonus = (F.when(op == "TYPE", F.when(f["tag"].isin(*POOL["TYPE"]), 2.0).otherwise(-1.0))
                 .when(op == "SELECT", F.when(f["tag"].isin(*POOL["SELECT"]), 2.0).otherwise(-1.0))
                 .otherwise(F.when(f["tag"].isin(*POOL["CLICK"]), 1.0).otherwise(0.0)))
    hit = lambda o: F.when(F.contains(task_lower, F.lower(o)), 2.0).otherwise(option_score(o, task_words))
    opts = F.when(op == "SELECT", F.aggregate(f["opts"], F.lit(0.0), lambda s, o: s + hit(o))).otherwise(0.0)
    return match_score(f, task_lower, task_words) + tag_bonus + opts


def best_candidate(cf: Column, score: Callable[[Column], Column], tags: Sequence[str] | Column | None = None) -> Column:
    """Highest score, then highest id, among candidates whose tag is in the pool; null for an empty pool."""
    if tags is None:
        pool = cf
    elif isinstance(tags, Column):
        pool = F.filter(cf, lambda f: F.array_contains(tags, f["tag"]))
    else:
        pool = F.filter(cf, lambda f: f["tag"].isin(*tags))
    ranked = F.transform(pool, lambda f: F.struct(F.round(score(f), 9).alias("s"), f["candidate_id"].alias("i"), f.alias("f")))
    return F.array_max(ranked)["f"]


def op_pool(op: Column) -> Column:
    arr = lambda k: F.array(*map(F.lit, POOL[k]))
    return F.when(op == "TYPE", arr("TYPE")).when(op == "SELECT", arr("SELECT")).otherwise(arr("CLICK"))


# ---------------------------------------------------------------- values

def label_candidates(c: Column) -> Column:
    """Names by which a task may call a candidate: longest first, no repeats in any case."""
    vals = F.transform(ps.all_matches(c["attrs"], LABEL_ATTRS, 2), lambda v: strip(v))
    spread = F.flatten(F.transform(vals, lambda v: F.array(v, strip(F.replace(v, F.lit("_"), F.lit(" "))))))
    names = F.filter(F.concat(F.array(strip(tx.text(c["text"]))), spread), lambda v: v != "")
    uniq = let(names, lambda a: F.filter(a, lambda v, i: ~F.exists(F.slice(a, F.lit(1), i), lambda x: F.lower(x) == F.lower(v))))
    keyed = F.transform(uniq, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def value_after_label(task: Column, c: Column) -> Column:
    """TYPE value: the phrase behind the longest label found in the task."""

    def phrase(lab: Column) -> Column:
        raw = strip(extract_dynamic(tx.text(task), F.concat(F.lit(r"(?iU)\b"), quote(lab), F.lit(AFTER_LABEL))))
        return strip(strip(F.regexp_replace(raw, VALUE_TAIL, "")), ",.;")

    return first_of(F.transform(label_candidates(c), phrase))


def longest_option_in_task(task: Column, options: Column) -> Column:
    """SELECT value: the longest option the task mentions, the first one on ties."""
    t = F.lower(tx.text(task))
    found = F.filter(options, lambda o: F.contains(t, F.lower(o)))
    keyed = F.transform(found, lambda o, i: F.struct(F.length(o).alias("n"), (-i).alias("i"), o.alias("o")))
    return F.coalesce(F.array_max(keyed)["o"], F.lit(""))


def best_option(options: Column, words: Column) -> Column:
    """struct<s,o,n>: highest word share, first one on ties, with its word count."""
    keyed = F.transform(options, lambda o, i: F.struct(
        option_score(o, words).alias("s"), (-i).alias("i"), o.alias("o"), F.size(tx.word_set(o)).alias("n")))
    return F.array_max(keyed)


def extract_value(task: Column, op: Column, f: Column, words: Column, variant: str = "newest") -> Column:
    """Layered value: option in the task, similar option, quoted text, text behind a field name, date.

    `f` is a parsed candidate (may be null). Variant `early` uses one threshold and takes ISO dates anywhere.
    """
    t = tx.text(task)
    tl = F.lower(t)
    opts = F.coalesce(f["opts"], F.expr("cast(array() as array<string>)"))
    exact = first_of(opts, lambda o: F.contains(tl, F.lower(o)))
    limit = (lambda n: F.when(n <= 1, 0.3).when(n >= 3, 0.6).otherwise(0.5)) if variant == "newest" else (lambda n: F.lit(0.5))
    similar = let(best_option(opts, words), lambda b: F.when((b["s"] > 0) & (b["s"] >= limit(b["n"])), b["o"]))
    quoted = F.nullif(F.regexp_extract(t, QUOTED, 1), F.lit(""))
    names = F.filter(F.array(*[tx.text(f[k]) for k in ("label", "placeholder", "aria", "name")]), lambda x: x != "")
    behind = first_of(F.transform(names, lambda n: strip(strip(extract_dynamic(
        t, F.concat(F.lit("(?iu)"), quote(strip(n)), F.lit(AFTER_FIELD)))), "\"'")))
    if variant == "newest":
        names_text = F.lower(F.concat_ws(" ", f["label"], f["placeholder"], f["aria"], f["name"]))
        is_date = F.lower(tx.text(f["type"])).contains("date") | names_text.contains("date")
        date = F.when(is_date, ps.first_filled(*[F.regexp_extract(t, p, 0) for p in DATES]))
    else:
        date = F.regexp_extract(t, DATES[0], 0)
    nz = lambda c: F.nullif(c, F.lit(""))
    by_option = F.when(op == "SELECT", F.coalesce(nz(exact), similar))
    return F.when(op == "CLICK", "").otherwise(F.coalesce(
        by_option, strip(quoted), F.when(op == "TYPE", nz(behind)), date, F.lit("")))


def value_by_regex(task: Column, op: Column) -> Column:
    """Value from the task text alone: quotes, e-mail, month and day, number, capitalised words."""
    t = tx.text(task)
    hit = lambda p, g=0: F.regexp_extract(t, p, g)
    typed = ps.first_filled(hit(QUOTED_ANY, 1), hit(EMAIL), hit(MONTH_DAY), hit(NUMBER), hit(CAPITALISED))
    chosen = ps.first_filled(hit(QUOTED_ANY, 1), hit(MONTH_DAY), hit(CAPITALISED))
    return F.when(op == "CLICK", "").when(op == "TYPE", typed).otherwise(chosen)


def snap_option(options: Column, words: Column, value: Column) -> Column:
    """Option for a value: equal text, then similar to the value, then closest to the task; '' without options."""
    v = F.lower(strip(value))
    equal = F.nullif(first_of(options, lambda o: F.lower(strip(o)) == v), F.lit(""))
    vw = tx.word_set(value)
    near = let(best_option(options, vw), lambda b: F.when((F.size(vw) > 0) & (b["s"] >= 0.5), b["o"]))
    by_task = best_option(options, words)["o"]
    return F.coalesce(equal, near, by_task, F.lit(""))


def merge_value(op: Column, value: Column, rule_value: Column) -> Column:
    """Model value first, the rule where it is empty, nothing for CLICK."""
    return F.when(op == "CLICK", "").otherwise(ps.first_filled(value, rule_value))


# ---------------------------------------------------------------- fallback and guard

def fallback(df: DataFrame, prefix: str = "fb_") -> DataFrame:
    """Rule-only answer: op from the verbs, best candidate of the op's tags, extracted value.

    Needs `with_fields`; adds `{prefix}op`, `{prefix}target_id`, `{prefix}value`.
    """
    tl, tw = F.col("tl"), F.col("tw")
    op = f"{prefix}op"
    df = pin(df.withColumn(op, op_from_task(F.col("task"))), op)
    score = lambda f: relevance_score(f, tl, tw, F.col(op))
    df = df.withColumn("_fb", F.coalesce(best_candidate(F.col("cf"), score, op_pool(F.col(op))), best_candidate(F.col("cf"), score)))
    return df.select("*", F.coalesce(F.col("_fb.candidate_id"), F.lit("")).alias(f"{prefix}target_id"),
                     F.when(F.col("_fb").isNull(), "").otherwise(extract_value(F.col("task"), F.col(op), F.col("_fb"), tw)).alias(f"{prefix}value")
                     ).drop("_fb")


AUDIT = ("bad_op_to_click", "invalid_target_repaired", "type_target_switched", "type_downgraded_click",
         "select_target_switched", "select_downgraded_click", "click_select_upgraded", "click_select_target_switched",
         "select_value_kept_raw", "select_value_repaired", "click_value_cleared")


def enforce(df: DataFrame, strict: bool = False) -> DataFrame:
    """Consistency guard over (op, target_id, value): repairs in a fixed order, one boolean flag per repair.

    `df` carries task, cands and the prediction. The costly parts (fallback answer, replacement
    candidate, value extraction) sit behind the condition that asks for them.
    """
    variant = "early" if strict else "newest"
    tl, tw, cf, task = F.col("tl"), F.col("tw"), F.col("cf"), F.col("task")
    lit0 = F.lit(False)
    by_match = lambda f: match_score(f, tl, tw)
    opu = F.upper(F.coalesce("op", F.lit("CLICK")))

    d = with_fields(df)
    d = d.withColumn("_op", F.when(opu.isin(*OPS), opu).otherwise("CLICK")).withColumn("bad_op_to_click", ~opu.isin(*OPS))
    d = d.withColumn("_hit", candidate_of(tx.text("target_id"), "cf")).withColumn("invalid_target_repaired", F.col("_hit").isNull())

    # 1. unknown target: the rule answer replaces the whole triple
    bad = F.col("invalid_target_repaired")
    d = pin(d.withColumn("_fop", F.when(bad, op_from_task(task))), "_hit", "invalid_target_repaired", "_fop")
    score = lambda f: relevance_score(f, tl, tw, F.col("_fop"))
    d = d.withColumn("_ch", F.when(bad, F.coalesce(best_candidate(cf, score, op_pool(F.col("_fop"))), best_candidate(cf, score)))
                     .otherwise(F.col("_hit")))
    d = d.withColumn("_val", F.when(bad, F.when(F.col("_ch").isNotNull(), extract_value(task, F.col("_fop"), F.col("_ch"), tw, variant)).otherwise(""))
                     .otherwise(tx.text("value"))).withColumn("_op", F.coalesce("_fop", "_op"))
    d = pin(d, "_ch", "_val", "_op")

    # 2. strict only: TYPE and SELECT must sit on fitting tags
    for op, low in (("TYPE", "type"), ("SELECT", "select")):
        if not strict:
            d = d.withColumn(f"{low}_target_switched", lit0).withColumn(f"{low}_downgraded_click", lit0)
            continue
        off = (F.col("_op") == op) & ~F.coalesce(F.col("_ch.tag"), F.lit("")).isin(*POOL[op])
        d = d.withColumn("_off", off).withColumn("_alt", F.when(F.col("_off"), best_candidate(cf, by_match, POOL[op])))
        sw = F.col("_off") & F.col("_alt").isNotNull()
        d = d.withColumn(f"{low}_target_switched", sw).withColumn(f"{low}_downgraded_click", F.col("_off") & F.col("_alt").isNull())
        sw, down = F.col(f"{low}_target_switched"), F.col(f"{low}_downgraded_click")
        d = d.withColumn("_val", F.when(sw, ps.first_filled(extract_value(task, F.lit(op), F.col("_alt"), tw, variant), F.col("_val")))
                         .when(down, "").otherwise(F.col("_val")))
        d = d.withColumn("_ch", F.when(sw, F.col("_alt")).otherwise(F.col("_ch"))).withColumn(
            "_op", F.when(down, "CLICK").otherwise(F.col("_op"))).drop("_off", "_alt")

    # 3. CLICK on a select: upgrade when the task names a value, else move to a clickable element
    on_select = (F.col("_op") == "CLICK") & (F.col("_ch.tag") == "select")
    d = d.withColumn("_sel", F.coalesce(on_select, lit0))
    d = d.withColumn("_ext", F.when(F.col("_sel"), extract_value(task, F.lit("SELECT"), F.col("_ch"), tw, variant)).otherwise(""))
    d = d.withColumn("click_select_upgraded", F.col("_ext") != "")
    d = d.withColumn("_alt", F.when(F.col("_sel") & ~F.col("click_select_upgraded"), best_candidate(cf, by_match, POOL["CLICK"])))
    d = d.withColumn("click_select_target_switched", F.col("_alt").isNotNull())
    up = F.col("click_select_upgraded")
    d = (d.withColumn("_op", F.when(up, "SELECT").otherwise(F.col("_op"))).withColumn("_val", F.when(up, F.col("_ext")).otherwise(F.col("_val")))
         .withColumn("_ch", F.coalesce("_alt", "_ch")))

    # 4. SELECT values snap to an option
    d = pin(d, "_ch", "_val", "_op")
    sel = F.col("_op") == "SELECT"
    d = d.withColumn("_snap", F.when(sel, snap_option(F.coalesce(F.col("_ch.opts"), F.expr("cast(array() as array<string>)")), tw, F.col("_val"))))
    d = d.withColumn("_raw", F.when(F.col("_snap") == "", ps.first_filled(
        F.col("_val"), extract_value(task, F.lit("SELECT"), F.col("_ch"), tw, variant))))
    d = d.withColumn("select_value_kept_raw", F.coalesce(F.col("_raw") != "", lit0))
    d = d.withColumn("select_value_repaired", F.coalesce((F.col("_snap") != "") & (F.col("_snap") != F.col("_val")), lit0))
    d = d.withColumn("_val", F.coalesce("_raw", "_snap", "_val"))

    # 5. CLICK never has a value
    click = F.col("_op") == "CLICK"
    d = d.withColumn("click_value_cleared", click & (F.col("_val") != ""))
    keep = [c for c in df.columns if c not in ("op", "target_id", "value")]
    return d.select(*keep, F.col("_op").alias("op"), F.coalesce(F.col("_ch.candidate_id"), F.lit("")).alias("target_id"),
                    F.when(click, "").otherwise(F.col("_val")).alias("value"), *AUDIT)


def repair_report(guarded: DataFrame, flags: Sequence[str] = AUDIT) -> DataFrame:
    """Count and share of every repair as a long table (one pass, partial sums only)."""
    sums = guarded.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return (sums.unpivot(["total"], list(flags), "repair", "n")
            .select("repair", "n", (F.col("n") / F.greatest("total", F.lit(1))).alias("share")))


def apply_rules(picked: DataFrame) -> DataFrame:
    """Heuristic answer for rows that carry `pick`: op from the tag, value from the task."""
    op = op_from_tag(F.col("pick.tag"))
    d = picked.withColumn("pred_op", op)
    value = (F.when(F.col("pred_op") == "SELECT", longest_option_in_task(F.col("task"), ps.options(F.col("pick.attrs"), "/")))
             .when(F.col("pred_op") == "TYPE", value_after_label(F.col("task"), F.col("pick"))).otherwise(""))
    d = d.withColumn("pred_value", F.when(F.col("pick").isNull(), "").otherwise(value)).withColumn("pred_target_id", F.col("pick_id"))
    return pin(d, "pred_op", "pred_value", "pred_target_id")
