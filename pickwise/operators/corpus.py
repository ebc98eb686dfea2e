"""Training records from decisions: candidate lists, prompts, reasoning, preference pairs, hard negatives.

All of it is row-level: candidates, shuffles and rejections are array expressions, so a record needs
no shuffle. Only page positions and retrieved examples arrive by a join on the decision id.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as ps, text as tx
from ..session import pin
from . import dom, rank as rk, rules as rl
from .rules import let

# Attributes shown in candidate lists, in order, and prefixes that are noise.
LIST_ATTRS = ("id", "name", "type", "role", "aria-label", "aria-labelledby", "aria-describedby", "aria-expanded", "aria-selected",
              "aria-checked", "placeholder", "value", "href", "for", "required", "disabled", "label", "options")
NOISE_PREFIXES = ("class", "style", "data-react", "data-v-", "data-test", "xpath", "jsname", "jsaction", "jscontroller",
                  "data-analytics", "tabindex", "data_", "data-ga", "data-track")
TEXT_FALLBACK = ("aria-label", "placeholder", "title", "role", "name")

# Sentences of the reasoning texts, default parameters: 1 the goal, 2 the element, 3 its place, 4 the contrast, 5 the value.
REASON = {
    "CLICK": "Goal \"%1$s\": a click belongs on %2$s%3$s%4$s.",
    "TYPE": "Goal \"%1$s\": the text '%5$s' goes into %2$s%3$s%4$s.",
    "SELECT": "Goal \"%1$s\": '%5$s' is an option of %2$s%3$s%4$s.",
}
REASON_EARLY = {"CLICK": "Clicking %2$s moves the task on.", "TYPE": "%2$s takes the text '%5$s'.", "SELECT": "%2$s offers '%5$s'."}
PLACE, CONTRAST = " inside %1$s", "; number %1$s has the same tag and fits less"

# Prompt wording. Every part is a parameter; braces are filled per row.
ROLE = "You operate a web page. Choose the next action that moves the task forward."
GUIDE = ("[Guidelines]\n1. Read the task and what was done before.\n2. Look for labels and values that fit the next open step.\n"
         "3. Tell similar elements apart by where they are.\n4. The operation must suit the element.\n5. Think first, then answer with JSON.")
ANSWER = '[Output Format]\n<think> short reasoning </think>\n{"op": "CLICK|TYPE|SELECT", "choice": <1-%s>, "value": "string"}'
ANSWER_ONLY = 'Answer with JSON only:\n{"op": "CLICK|TYPE|SELECT", "choice": <number 1-%s>, "value": "text, empty for CLICK"}'


def clean(c: Column) -> Column:
    return tx.strip(tx.text(c))


# ---------------------------------------------------------------- candidate lists

def _shown_text(text: Column, pairs: Column, n: int) -> Column:
    """Own text, or the first filled attribute of the fallback chain as [key:value]."""
    hints = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), ps.pair(pairs, k).alias("v")) for k in TEXT_FALLBACK]), lambda s: s["v"] != "")
    hint = F.try_element_at(hints, F.lit(1))
    return F.when(text != "", text).otherwise(F.coalesce(F.concat(F.lit("["), hint["k"], F.lit(":"), F.substring(hint["v"], 1, n), F.lit("]")), F.lit("")))


def _key_parts(pairs: Column, compact: bool) -> Column:
    known = F.array(*map(F.lit, dom.LIST_ATTRS_COMPACT if compact else LIST_ATTRS))
    # the few pairs look up their place among the keys; of a key that repeats the last pair counts
    last = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["k"] == p["k"])
    placed = F.transform(F.filter(pairs, lambda p, i: F.array_contains(known, p["k"]) & (p["v"] != "") & last(p, i)),
                         lambda p: F.struct(F.array_position(known, p["k"]).alias("at"), p["k"].alias("k"), p["v"].alias("v")))
    shown = F.transform(F.array_sort(placed), lambda s: F.concat(s["k"], F.lit("="), F.substring(s["v"], 1, 60)))
    if compact:
        return shown
    noisy = lambda k: F.exists(F.array(*map(F.lit, NOISE_PREFIXES)), lambda p: F.startswith(k, p))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    extra = F.slice(F.filter(keys, lambda k: ~F.array_contains(known, k) & ~noisy(k)), 1, 2)
    value = lambda k: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"], F.lit(""))
    return F.concat(shown, F.transform(extra, lambda k: F.concat(k, F.lit("="), F.substring(value(k), 1, 40))))


def _number(i: Column) -> Column:
    return F.concat(F.lpad((i + 1).cast("string"), F.greatest(F.length((i + 1).cast("string")), F.lit(2)), F.lit(" ")), F.lit(". "))


def candidate_line(c: Column, i: Column, mode: str = "full") -> Column:
    """One numbered line; mode full, compact or legacy."""
    return F.concat(_number(i), candidate_shown(c, mode))


def candidate_shown(c: Column, mode: str = "full", pairs: Column | None = None) -> Column:
    """A candidate's line without its number; `pairs` are its attributes if they are parsed already."""
    head = F.concat(F.lit("["), tx.text(c["tag"]), F.lit("]"))
    quoted = lambda t: F.when(t != "", F.concat(F.lit(' "'), t, F.lit('"'))).otherwise("")
    if mode == "legacy":
        a = clean(c["attrs"])
        short = F.when(F.length(a) > 120, F.concat(F.substring(a, 1, 120), F.lit("..."))).otherwise(a)
        return F.concat(head, quoted(clean(c["text"])), F.when(short != "", F.concat(F.lit(" | "), short)).otherwise(""))

    def line(p: Column) -> Column:
        parts = _key_parts(p, mode == "compact")
        return F.concat(head, quoted(F.substring(_shown_text(clean(c["text"]), p, 40), 1, 60)),
                        F.when(F.size(parts) > 0, F.concat(F.lit(" | "), F.array_join(parts, " | "))).otherwise(""))

    return let(ps.attr_pairs(c["attrs"]), line) if pairs is None else line(pairs)


def format_candidates(cands: Column, mode: str = "full") -> Column:
    return F.array_join(F.transform(cands, lambda c, i: candidate_line(c, i, mode)), "\n")


def with_shown(df: DataFrame, mode: str = "full") -> DataFrame:
    """`cands` as struct<candidate_id,tag,label,shown>: what copies of a decision need of a candidate, made once for all of them."""
    one = lambda c: let(ps.attr_pairs(c["attrs"]), lambda p: F.struct(c["candidate_id"].alias("candidate_id"), c["tag"].alias("tag"), label_of(c, p).alias("label"), candidate_shown(c, mode, p).alias("shown")))
    return pin(df.withColumn("cands", F.transform("cands", one)), "cands")


def _repr(c: Column) -> Column:
    """Quoted text: single quotes unless the text holds only those."""
    s = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return (F.when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), s, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def debug_listing(task: Column, op: Column, value: Column, target: Column, cands: Column) -> Column:
    """Readable sheet of one decision; the target is marked."""
    mark = lambda c: F.when(c["candidate_id"] == target, ">>> ").otherwise("    ")
    line = lambda c: F.concat(mark(c), c["candidate_id"], F.lit(" <"), c["tag"], F.lit("> text="), _repr(F.substring(tx.text(c["text"]), 1, 50)), F.lit(" attrs="), _repr(F.substring(tx.text(c["attrs"]), 1, 40)))
    head = F.concat(F.lit("Task : "), task, F.lit("\nOp   : "), op, F.lit("\nValue: "), value, F.lit("\nTarget: "), target, F.lit("\n" + "-" * 60 + "\n"))
    return F.concat(head, F.array_join(F.transform(cands, line), "\n"))


def rerank(df: DataFrame, score: Callable[[Column], Column] | None = None, out: str = "prompt_cands") -> DataFrame:
    """Candidates by falling score, original order on ties, as column `out`.

    Default score is the lexical match with the task; `score` takes a parsed candidate. Choice numbers
    of a prompt built on `out` must be decoded against `out`.
    """
    d = rl.with_fields(df)
    score = score or (lambda f: rl.match_score(f, F.col("tl"), F.col("tw")))
    keyed = F.transform(F.arrays_zip("cands", "cf"), lambda z, i: F.struct((-F.round(score(z["cf"]), 9)).alias("s"), i.alias("i"), z["cands"].alias("c")))
    return d.withColumn(out, F.transform(F.array_sort(keyed), lambda s: s["c"])).drop("cf", "tl", "tw")


# ---------------------------------------------------------------- prompts and reasoning

def prompt_parts(df: DataFrame, cands: str = "cands", examples: DataFrame | None = None, variant: str = "newest", history_sep: str = "pipe",
                 role: str = ROLE, guide: str = GUIDE) -> DataFrame:
    """Adds `_head` and `_tail`, the prompt's text before and behind the list; the order of the candidates changes neither."""
    d = df
    if examples is not None:
        d = d.join(examples.select("id", "examples"), "id", "left")
    d = pin(d.withColumn("_kind", ps.html_type("cleaned_html")), "_kind")
    d = pin(d.withColumn("_w", F.when(F.col("_kind") == "workflow", ps.workflow_status("cleaned_html"))), "_w")  # other pages show no status
    n = F.size(F.col(cands)).cast("string")
    task = tx.text("task")
    done = F.array_join(F.col("_w.completed_fields"), ", ")
    flow = F.col("_kind") == "workflow"
    shown = F.col("examples") if examples is not None else F.lit(None).cast("string")
    if variant == "early":
        step = F.when(F.col("_w.current_step") != "", F.concat(F.lit("Progress: step "), "_w.current_step", F.lit(" of "), "_w.total_steps")).otherwise("")
        fields = F.when(done != "", F.concat(F.lit("Already completed (do not select): "), done)).otherwise("")
        history = F.when(tx.text("history") == "", "None").otherwise(tx.text("history"))
        tail = F.when(flow, F.concat(F.lit("[Workflow Status]\n"), step, F.lit("\n"), fields)).otherwise(tx.text(shown))
        head = F.concat(F.lit(role + "\n\n[Candidate Elements] — choose one number (1-"), n, F.lit(")\n"))
        tail = F.concat(F.lit("\n\n[Task]\n"), task, F.lit("\n\n[History]\n"), history, F.lit("\n\n"), tail, F.lit("\n\n"), F.format_string(ANSWER_ONLY, n))
    else:
        status = F.concat(F.lit("\n\n[Workflow Status]\nStep "), "_w.current_step", F.lit(" of "), "_w.total_steps", F.lit("\n"),
                          F.when(done != "", F.concat(F.lit("Completed Fields: "), done, F.lit("\n"))).otherwise(""))
        block = F.coalesce(F.concat(shown, F.lit("\n\n")), F.lit(""))
        head = F.concat(F.lit(role + "\n\n"), block, F.lit("[Candidate Elements] (Total: "), n, F.lit(")\n"))
        tail = F.concat(F.lit("\n\n[Task]\n"), task, F.lit("\n\n[History]\n"),
                        ps.compress_history("history", history_sep), F.lit(f"\n\n{guide}\n\n"), F.format_string(ANSWER, n), F.when(flow, status).otherwise(""))
    return pin(d.withColumn("_head", head).withColumn("_tail", tail), "_head", "_tail").drop("_w", "_kind", *(["examples"] if examples is not None else []))


def build_prompt(df: DataFrame, cands: str = "cands", examples: DataFrame | None = None, tree: DataFrame | None = None, mode: str = "full",
                 variant: str = "newest", history_sep: str = "pipe", role: str = ROLE, guide: str = GUIDE) -> DataFrame:
    """Adds `prompt`. `examples` (id, examples) and `tree` (id, tree) are joined on id when given.

    What `prompt_parts` and `with_shown` have made before is taken over.
    """
    d = df if "_head" in df.columns else prompt_parts(df, cands, examples, variant, history_sep, role, guide)
    if tree is not None:
        d = d.join(tree.select("id", "tree"), "id", "left")
    if "shown" in d.schema[cands].dataType.elementType.names:
        numbered = F.array_join(F.transform(cands, lambda c, i: F.concat(_number(i), c["shown"])), "\n")
    else:
        numbered = format_candidates(F.col(cands), "legacy" if variant == "early" else mode)
    if tree is not None:
        numbered = F.coalesce(F.nullif(F.col("tree"), F.lit("")), numbered)
    return d.withColumn("prompt", F.concat("_head", numbered, "_tail")).drop("_head", "_tail", *(["tree"] if tree is not None else []))


def _sentence(op: Column, sentences: Mapping[str, str], goal: Column, element: Column, place: Column, contrast: Column, value: Column) -> Column:
    said = {k: F.format_string(v, goal, element, place, contrast, value) for k, v in sentences.items()}
    return F.when(op == "CLICK", said["CLICK"]).when(op == "TYPE", said["TYPE"]).otherwise(said["SELECT"])


def reasoning(task: Column, op: Column, choice: Column, c: Column, value: Column, cands: Column, place: Column | None = None,
              sentences: Mapping[str, str] = REASON, placed: str = PLACE, contrasted: str = CONTRAST, label: Column | None = None) -> Column:
    """Reasoning sentence, at most 200 characters. `choice` is 1-based, `place` a location hint, `label` that of `c` if it is known."""
    other = F.try_element_at(F.filter(F.transform(cands, lambda x, i: F.when((i + 1 != choice) & (tx.text(x["tag"]) == tx.text(c["tag"])), i + 1)), lambda n: n.isNotNull()), F.lit(1))
    contrast = F.when(other.isNotNull(), F.format_string(contrasted, other.cast("string"))).otherwise("")
    element = F.concat(tx.text(c["tag"]), F.lit(" number "), choice.cast("string"), F.lit(" ("), F.substring(label_of(c) if label is None else label, 1, 20), F.lit(")"))
    where = F.lit("") if place is None else F.when(tx.text(place) != "", F.format_string(placed, tx.text(place))).otherwise("")
    return F.substring(_sentence(op, sentences, F.substring(clean(task), 1, 40), element, where, contrast, F.substring(value, 1, 20)), 1, 200)


def reasoning_early(op: Column, choice: Column, c: Column, value: Column, sentences: Mapping[str, str] = REASON_EARLY) -> Column:
    label = label_of(c)
    element = F.concat(F.lit("Number "), choice.cast("string"), F.lit(", "), tx.text(c["tag"]), F.when(label != "", F.concat(F.lit(" "), F.substring(label, 1, 40))).otherwise(""))
    none = F.lit("")
    return _sentence(op, sentences, none, element, none, none, F.substring(value, 1, 30))


def label_of(c: Column, pairs: Column | None = None) -> Column:
    label = lambda p: clean(ps.first_filled(clean(c["text"]), *[ps.pair(p, k) for k in ps.DESCRIPTION_CHAIN]))
    return let(ps.attr_pairs(c["attrs"]), label) if pairs is None else label(pairs)


def answer_json(op: Column, choice: Column, value: Column) -> Column:
    return F.to_json(F.struct(op.alias("op"), choice.alias("choice"), value.alias("value")), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- negatives

def pairs_first(df: DataFrame) -> DataFrame:
    """Preference pair: the truth against the first other candidate, or an altered op if there is none."""
    value = F.nullif(tx.text("value"), F.lit(""))
    other = F.try_element_at(F.filter("cands", lambda c: c["candidate_id"] != F.col("target_id")), F.lit(1))["candidate_id"]
    alt = F.when(F.col("op") != "CLICK", "CLICK").otherwise("TYPE")
    js = lambda o, t, v: F.to_json(F.struct(o.alias("op"), t.alias("target_id"), v.alias("value")), {"ignoreNullFields": "false"})
    rejected = F.when(other.isNotNull(), js(F.col("op"), other, value)).otherwise(js(alt, F.col("target_id"), F.when(alt == "TYPE", "wrong_value")))
    return df.select("id", js(F.col("op"), F.col("target_id"), value).alias("chosen"), rejected.alias("rejected"))


def is_false_negative(a: Column, b: Column) -> Column:
    """Whether candidate a is too much like the target b to serve as a wrong answer (parsed candidates)."""
    same = lambda k: (F.lower(clean(a[k])) != "") & (F.lower(clean(a[k])) == F.lower(clean(b[k])))
    return (a["candidate_id"] == b["candidate_id"]) | same("text") | same("label") | same("aria") | (same("name") & same("placeholder"))


def path_at(places: Column, pos: Column) -> Column:
    return F.try_element_at(F.filter(places, lambda p: p["cand_pos"] == pos), F.lit(1))["path"]


def hard_negative(df: DataFrame, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds `neg_pos` (0-based) and `neg_score`: the most tempting wrong candidate.

    Look-alikes of the target are left out unless nothing else remains. Score = nearness in the page
    (up to 1) + 0.5 for the same parent + 1.5 × rank share by relevance + 0.2 for the same tag; the
    first one wins ties. Null when the target is absent or alone. The page counts if `df` has `places` (see `dom.with_places`).
    """
    placed = "places" in df.columns
    d = pin(rl.with_fields(df).withColumn("_tp", rk.target_pos()), "_tp")
    d = pin(d.withColumn("_t", F.try_element_at("cf", F.col("_tp") + 1)), "_t")
    score = score or (lambda f: rl.match_score(f, F.col("tl"), F.col("tw")))
    t = F.col("_t")
    others = F.filter(F.transform("cf", lambda f, i: F.struct(i.alias("i"), f.alias("f"))), lambda o: o["i"] != F.col("_tp"))
    d = d.withColumn("_o", F.when(F.col("_tp").isNotNull(), others)).withColumn("_k", F.filter("_o", lambda o: ~is_false_negative(o["f"], t)))
    d = pin(d, "_o", "_k")
    pool = F.when(F.size("_k") > 0, F.col("_k")).otherwise(F.col("_o"))
    d = d.withColumn("_o", F.transform(pool, lambda o: F.struct(o["i"].alias("i"), o["f"]["tag"].alias("tag"), F.round(score(o["f"]), 9).alias("s"))))
    d = pin(d, "_o")
    if placed:
        d = pin(d.withColumn("_tpath", path_at(F.col("places"), F.col("_tp"))), "_tpath")

        def near(o: Column) -> Column:
            def points(p: Column) -> Column:
                parent = lambda x: F.coalesce(F.when(F.size(x) > 1, F.element_at(x, -2)["pos"]), F.lit(-1))
                mine = F.col("_tpath")
                close = F.greatest(F.lit(0), 20 - dom.distance(mine, p)) / 20.0
                return F.when(p.isNull() | mine.isNull(), 0.0).otherwise(close + F.when(parent(mine) == parent(p), 0.5).otherwise(0.0))
            return let(path_at(F.col("places"), o["i"]), points)
    else:
        near = lambda o: F.lit(0.0)
    o_ = F.col("_o")
    n = F.size(o_)

    def total(o: Column) -> Column:
        ahead = F.size(F.filter(o_, lambda x: (x["s"] > o["s"]) | ((x["s"] == o["s"]) & (x["i"] < o["i"]))))
        return F.round(near(o) + 1.5 * (n - ahead) / n + F.when(o["tag"] == t["tag"], 0.2).otherwise(0.0), 9)

    best = F.array_max(F.transform(o_, lambda o: F.struct(total(o).alias("s"), (-o["i"]).alias("i"))))
    return pin(d.withColumn("_b", best), "_b").select(*df.columns, (-F.col("_b.i")).alias("neg_pos"), F.col("_b.s").alias("neg_score"))


# ---------------------------------------------------------------- augmentation

def augment_shuffle(df: DataFrame, n: int = 1, realweb_mult: int = 3, seed: int = 42, html_type: str = "html_type", original: bool = False) -> DataFrame:
    """n shuffled copies per decision (times `realweb_mult` for real pages), numbered `aug` from 1.

    Order comes from a keyed hash. A same-tag candidate, if any, is swapped next to the target: in
    front of it, or behind when the target is first. With `original` the unshuffled row is kept as
    aug 0, from the same explode.
    """
    copies = F.when(F.col(html_type) == "real_web", n * realweb_mult).otherwise(n)
    d = df.filter(F.exists("cands", lambda c: c["candidate_id"] == F.col("target_id")))
    d = d.withColumn("aug", F.explode(F.sequence(F.lit(0), copies)) if n > 0 else F.lit(0))
    if not original:
        d = d.filter("aug > 0")
    key = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.col("aug").cast("string"), c["candidate_id"]))
    keyed = F.transform("cands", lambda c, i: F.struct(F.when(F.col("aug") > 0, key(c)).otherwise("").alias("h"), i.alias("i"), c.alias("c")))
    d = d.withColumn("_s", F.transform(F.array_sort(keyed), lambda s: s["c"]))
    d = pin(pin(d, "_s").withColumn("_tp", rk.target_pos("_s")), "_tp")
    s = F.col("_s")
    tag = F.element_at(s, F.col("_tp") + 1)["tag"]
    same = F.filter(F.transform(s, lambda c, i: F.when((i != F.col("_tp")) & (c["tag"] == tag), i)), lambda i: i.isNotNull())
    d = d.withColumn("_hn", F.when(F.col("aug") > 0, F.try_element_at(same, F.lit(1)))).withColumn("_to", F.when(F.col("_tp") > 0, F.col("_tp") - 1).otherwise(F.col("_tp") + 1))
    d = pin(d, "_hn", "_to")
    hn, to = F.col("_hn"), F.col("_to")
    swapped = F.transform(s, lambda c, i: F.when(i == hn, F.element_at(s, to + 1)).when(i == to, F.element_at(s, hn + 1)).otherwise(c))
    return pin(d.withColumn("cands", F.when(hn.isNotNull() & (to < F.size(s)), swapped).otherwise(s)).drop("_s", "_tp", "_hn", "_to"), "cands")


def corrupt_op(op: Column, value: Column, key: Column, p: float = 0.33, seed: int = 42) -> Column:
    """struct<op,value> of a rejected action: with probability p a TYPE or SELECT becomes a CLICK."""
    hit = op.isin("TYPE", "SELECT") & (tx.md5_unit(seed, key) < p)
    return F.struct(F.when(hit, "CLICK").otherwise(op).alias("op"), F.when(hit, "").otherwise(value).alias("value"))


# ---------------------------------------------------------------- corpus

def build_corpus(df: DataFrame, mode: str = "preference", examples: DataFrame | None = None, shuffle_n: int = 1,
                 realweb_mult: int = 3, compact: bool = False, p_corrupt: float = 0.33, seed: int = 42) -> DataFrame:
    """Training records (id, aug, html_type, prompt, chosen, rejected) or (…, instruction, input, output).

    aug 0 is the original order, the others are shuffled copies. Decisions whose target is absent, and
    in preference mode those without a wrong candidate, give no record; `skipped` counts them. With `places` in `df` the page
    takes part in the choice of the wrong candidate and in the reasons.
    """
    placed = "places" in df.columns
    d = df.drop("els").filter(F.exists("cands", lambda c: c["candidate_id"] == F.col("target_id"))).withColumn("html_type", ps.html_type("cleaned_html"))
    d = d.withColumn("value", F.when(F.col("op") == "CLICK", "").otherwise(tx.text("value")))
    pref = mode == "preference"
    if pref:
        # The wrong answer is chosen once and kept through all shuffles. It exists as soon as there is a
        # second candidate; testing that instead of the result keeps the scoring out of the filter.
        d = hard_negative(d.filter(F.size("cands") > 1))
        d = d.withColumn("neg_id", F.element_at("cands", F.col("neg_pos") + 1)["candidate_id"])
        d = d.withColumn("bad", corrupt_op(F.col("op"), F.col("value"), F.col("id"), p_corrupt, seed)).drop("neg_pos", "neg_score")
    hints = F.expr("cast(array() as array<struct<candidate_id:string,hint:string>>)")
    if placed:
        ids = F.col("cands")
        hints = F.coalesce(F.transform("places", lambda p: F.struct(F.element_at(ids, p["cand_pos"] + 1)["candidate_id"].alias("candidate_id"), dom.location_hint(p["path"]).alias("hint"))), hints)
    d = pin(d.withColumn("_hints", hints), "_hints")
    # made once, before a decision has copies
    d = prompt_parts(d, examples=examples).drop("history", "cleaned_html", "places")
    d = augment_shuffle(with_shown(d, "compact" if compact else "full"), shuffle_n, realweb_mult, seed, original=True)
    found = lambda cid: F.array_position(F.transform("cands", lambda c: c["candidate_id"]), cid).cast("int")
    d = build_prompt(d).withColumn("_at_good", found(F.col("target_id"))).withColumn("_at_bad", found(F.col("neg_id")) if pref else F.lit(0))
    d = pin(d, "prompt", "_at_good", "_at_bad")

    def side(cid: Column, at: Column, op: Column, value: Column) -> Column:
        c = F.element_at("cands", at)
        place = F.coalesce(F.try_element_at(F.filter("_hints", lambda h: h["candidate_id"] == cid), F.lit(1))["hint"], F.lit(""))
        why = reasoning(F.col("task"), op, at, c, value, F.col("cands"), place, label=c["label"])
        return F.concat(F.lit("<think>\n"), why, F.lit("\n</think>\n"), answer_json(op, at, value))

    good = side(F.col("target_id"), F.col("_at_good"), F.col("op"), F.col("value"))
    if pref:
        return d.select("id", "aug", "html_type", F.concat(F.lit("### Instruction:\n"), "prompt", F.lit("\n\n### Response:\n")).alias("prompt"), good.alias("chosen"),
                        side(F.col("neg_id"), F.col("_at_bad"), F.col("bad.op"), F.col("bad.value")).alias("rejected"))
    return d.select("id", "aug", "html_type", F.col("prompt").alias("instruction"), F.lit("").alias("input"), good.alias("output"))


def skipped(df: DataFrame) -> DataFrame:
    """How many decisions give a record and how many lack their target."""
    has = F.coalesce(F.exists("cands", lambda c: c["candidate_id"] == F.col("target_id")), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("used"), F.count_if(~has).alias("skipped"))
