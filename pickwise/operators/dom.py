"""Pages as tables: tag stream, depths, ancestors, distances, element matching and context.

A page is one row, so its tags are bounded by that row. Pages are partitioned by their key before the
tags are exploded; depth, ancestors and context then run on windows and joins that reuse the key.
The tree follows the tag stream: every open tag opens, every close tag closes, depth never falls
below 0, and missing close tags are not repaired.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import parse as ps, text as tx
from ..functions.parse import first_filled
from ..session import pin, stack

# Shape of one tag with the text behind it, tags without content, context containers.
TAG = r"<(/?)([\p{L}\p{N}_]+)([^>]*)>([^<]*)"
COMMENT = r"(?s)<!--.*?(?:-->|$)"
RAW_BODY = r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>|$)"
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CONTAINERS = ("form", "fieldset", "section", "nav", "header", "main", "footer")
ROOTS = ("html", "body")
KEPT_ATTRS = ("id", "name", "type", "value", "placeholder", "aria-label", "text", "role")
MATCH_KEYS = ("id", "name", "placeholder", "aria-label")


def html_attr(attrs: Column, key: str) -> Column:
    """Value of a tag attribute, quoted or bare; '' when absent."""
    p = rf"""(?i)(?:^|\s){key}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return first_filled(*[F.regexp_extract(attrs, p, g) for g in (1, 2, 3)])


def tag_stream(pages: DataFrame, key: str = "page_id", html: str = "html", void_leaf: bool = False) -> DataFrame:
    """One row per tag in text order: pos, closes, tag, attrs, text, step (+1 opens, -1 closes, 0 leaf), depth.

    depth is the depth of an open tag itself, or of the level a close tag returns to. With
    `void_leaf` (the tree form) tags that never have content (input, br, …) do not open a level, and
    comments and the bodies of scripts and styles are left out.
    """
    source = tx.text(html)
    if void_leaf:  # what a script, style or comment holds is no element; done in the row, before the tags are taken
        source = F.regexp_replace(F.regexp_replace(source, COMMENT, ""), RAW_BODY, "$1$3")
    tags = pages.select(key, F.regexp_extract_all(source, F.lit(TAG), F.lit(0)).alias("_tags"))
    raw = tags.repartition(key).select(key, F.posexplode("_tags").alias("pos", "_m"))
    m = F.col("_m")
    d = raw.select(key, "pos", m.startswith("</").alias("closes"), F.regexp_extract(m, TAG, 2).alias("tag"), F.regexp_extract(m, TAG, 3).alias("attrs"),
                   tx.strip(F.regexp_extract(m, TAG, 4)).alias("text"))
    leaf = F.col("tag") == "text"
    if void_leaf:
        leaf = leaf | F.lower("tag").isin(*VOID_TAGS)
        d = d.filter(~(F.col("closes") & F.lower("tag").isin(*VOID_TAGS)))
    d = d.withColumn("step", F.when(F.col("closes"), -1).when(leaf, 0).otherwise(1))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum("step").over(w)).withColumn("_low", F.min("_s").over(w))
    after = F.col("_s") - F.least(F.lit(0), F.col("_low"))
    return d.withColumn("depth", (after - F.greatest("step", F.lit(0))).cast("int")).drop("_s", "_low")


def nodes(stream: DataFrame) -> DataFrame:
    """Only the open tags."""
    return stream.filter(~F.col("closes")).drop("closes")


def html_outline(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Outline rows (pos, depth, label, text): label is the tag with its aria label."""
    n = nodes(tag_stream(pages, key, html))
    aria = F.regexp_extract("attrs", r'aria_label="([^"]+)"', 1)
    label = F.when(aria != "", F.concat("tag", F.lit(" ["), aria, F.lit("]"))).otherwise(F.col("tag"))
    return n.select(key, "pos", "depth", F.when(F.col("tag") == "text", "").otherwise(label).alias("label"), "text")


def with_paths(nodes_: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """Ancestor path of the wanted (key, pos): array<struct<level,pos,tag,hint>> from the root to the element itself.

    Every wanted node asks each level up to its own for the last node seen there: one running window
    per (page, level) over nodes and questions, linear in nodes plus answers. A leaf cannot hide an
    open element of its level, so leaves count as nodes too.
    """
    hint = first_filled(html_attr(F.col("attrs"), "id"), html_attr(F.col("attrs"), "aria-label"), html_attr(F.col("attrs"), "role"))
    flag = wanted.select(key, "pos").distinct().withColumn("_want", F.lit(True))
    here = nodes_.select(key, "pos", "depth", F.struct(F.col("depth").alias("level"), "pos", "tag", hint.alias("hint")).alias("node")).join(flag, [key, "pos"], "left")
    row = lambda level, ask: F.struct(level.alias("level"), F.lit(ask).alias("ask"))
    asked = F.when(F.col("_want"), F.transform(F.sequence(F.lit(0), F.col("depth")), lambda l: row(l, 1)))
    rows = here.select(key, "pos", "node", F.explode(F.concat(F.array(row(F.col("depth"), 0)), F.coalesce(asked, F.array_repeat(row(F.lit(0), 1), F.lit(0))))).alias("x"))
    w = Window.partitionBy(key, "x.level").orderBy("pos", "x.ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("x.ask") == 0, F.col("node")), ignorenulls=True).over(w)
    return (rows.withColumn("anc", seen).filter("x.ask = 1").groupBy(key, "pos").agg(F.array_sort(F.collect_list("anc")).alias("path")))


def distance(a: Column, b: Column) -> Column:
    """Tree distance of two ancestor paths: depths minus twice the shared part; 999 if one is missing."""
    shared = F.size(F.filter(F.zip_with(a, b, lambda x, y: x["pos"] == y["pos"]), lambda s: s))
    return F.when(a.isNull() | b.isNull(), 999).otherwise(F.size(a) + F.size(b) - 2 * shared)


def dom_distance(nodes_: DataFrame, pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """Distance of each pair (key, a, b) of node positions."""
    wanted = pairs.select(key, F.explode(F.array("a", "b")).alias("pos"))
    paths = with_paths(nodes_, wanted, key)
    side = lambda c: paths.select(key, F.col("pos").alias(c), F.col("path").alias(f"_p{c}"))
    d = pairs.join(side("a"), [key, "a"], "left").join(side("b"), [key, "b"], "left")
    return d.withColumn("distance", distance(F.col("_pa"), F.col("_pb"))).drop("_pa", "_pb")


def above(path: Column) -> Column:
    """Ancestors from the outermost to the parent, cut below html and body."""
    up = F.slice(path, F.lit(1), F.size(path) - 1)
    cut = F.array_max(F.transform(up, lambda n, i: F.when(F.lower(n["tag"]).isin(*ROOTS), i).otherwise(-1)))
    start = F.coalesce(cut, F.lit(-1)) + 2
    return F.slice(up, start, F.greatest(F.size(up) - start + 1, F.lit(0)))


def ancestor_text(path: Column) -> Column:
    """The whole ancestor path as `tag > tag`."""
    return F.array_join(F.transform(above(path), lambda n: n["tag"]), " > ")


def location_hint(path: Column) -> Column:
    """Grandparent and parent as `tag#hint > tag#hint`."""
    up = above(path)
    near = F.slice(up, F.greatest(F.size(up) - 1, F.lit(1)), F.lit(2))
    show = lambda n: F.concat(n["tag"], F.when(n["hint"] != "", F.concat(F.lit("#"), F.substring(n["hint"], 1, 15))).otherwise(""))
    return F.array_join(F.transform(near, show), " > ")


def ancestors(nodes_: DataFrame, key: str = "page_id") -> DataFrame:
    """Every node with its ancestor path text, its depth below the root levels and its location hint."""
    paths = with_paths(nodes_, nodes_, key)
    p = F.col("path")
    return paths.select(key, "pos", F.element_at(p, -1)["tag"].alias("tag"), ancestor_text(p).alias("ancestors"), location_hint(p).alias("hint"))


# ---------------------------------------------------------------- texts and matching

def element_texts(stream: DataFrame, paths: DataFrame, key: str = "page_id", limit: int = 60) -> DataFrame:
    """First `limit` characters of the text inside each node that has a path row, in text order.

    Each text piece belongs to the innermost open element and to all its ancestors. A piece has at
    least one character, so the first `limit` pieces of an element suffice; the group limit is
    applied below the shuffle.
    """
    # a text behind a close tag belongs to the last node opened one level up
    level = F.when(F.col("closes"), F.col("depth") - 1).otherwise(F.col("depth"))
    row = lambda l, ask: F.struct(l.alias("level"), F.lit(ask).alias("ask"))
    none = F.array_repeat(row(F.lit(0), 0), F.lit(0))
    opens = F.when(F.col("step") == 1, F.array(row(F.col("depth"), 0))).otherwise(none)
    asks = F.when((F.col("text") != "") & (level >= 0) & (F.col("closes") | (F.col("step") == 1)), F.transform(F.sequence(F.lit(0), level), lambda l: row(l, 1))).otherwise(none)
    rows = stream.select(key, "pos", "text", F.explode(F.concat(opens, asks)).alias("x"))
    w = Window.partitionBy(key, "x.level").orderBy("pos", "x.ask").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (rows.withColumn("el", F.last(F.when(F.col("x.ask") == 0, F.col("pos")), ignorenulls=True).over(w))
              .filter("x.ask = 1 and el is not null").select(key, "el", "pos", "text"))
    need = paths.select(key, F.col("pos").alias("el")).distinct()
    first = Window.partitionBy(key, "el").orderBy("pos")
    kept = pieces.join(need, [key, "el"], "left_semi").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "")
    return kept.groupBy(key, "el").agg(F.substring(joined, 1, limit).alias("inner_text")).select(key, F.col("el").alias("pos"), "inner_text")


def match_elements(cand: DataFrame, stream: DataFrame, key: str = "id") -> DataFrame:
    """(key, cand_pos, pos): the page element of each candidate.

    The first element of the candidate's tag with an equal id, name, placeholder or aria-label (in
    that order of trust), else the first whose text begins with the candidate's text (60 characters).
    `cand` has key, cand_pos, tag, text, attrs. Equality joins only.
    """
    pairs = ps.attr_pairs("attrs")
    keyed = lambda get: F.filter(F.array(*[F.struct(F.lit(i).alias("prio"), get(k).alias("v")) for i, k in enumerate(MATCH_KEYS)]), lambda s: s["v"] != "")
    c = cand.select(key, "cand_pos", "tag", "text", pairs.alias("_p")).select(key, "cand_pos", "tag", F.explode(keyed(lambda k: ps.pair(F.col("_p"), k))).alias("m"))
    n = nodes(stream)
    e = n.select(key, "pos", "tag", F.explode(keyed(lambda k: html_attr(F.col("attrs"), k))).alias("m"))
    by_attr = (c.select(key, "cand_pos", "tag", "m.prio", "m.v").join(e.select(key, "pos", "tag", "m.prio", "m.v"), [key, "tag", "prio", "v"])
               .select(key, "cand_pos", "prio", "pos"))
    words = cand.select(key, "cand_pos", "tag", F.substring(tx.strip("text"), 1, 60).alias("v")).filter("v <> ''")
    same_tag = n.join(words.select(key, "tag").distinct(), [key, "tag"], "left_semi")
    texts = element_texts(stream, same_tag, key).join(same_tag.select(key, "pos", "tag"), [key, "pos"])
    by_text = words.join(texts.select(key, "pos", "tag", F.col("inner_text").alias("v")), [key, "tag", "v"]).select(key, "cand_pos", F.lit(9).alias("prio"), "pos")
    return stack(by_attr, by_text).groupBy(key, "cand_pos").agg(F.min(F.struct("prio", "pos")).alias("m")).select(key, "cand_pos", "m.pos")


def element_context(matched: DataFrame, stream: DataFrame, key: str = "id") -> DataFrame:
    """Context text per matched candidate: label, container, up to 3 children and 5 neighbours."""
    n = nodes(stream)
    a = F.col("attrs")
    # elements with their parent; text for those that are asked for
    all_paths = with_paths(n, n, key)
    parents = all_paths.select(key, "pos", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"))
    el = n.join(parents, [key, "pos"]).select(key, "pos", "tag", "attrs", F.col("parent.pos").alias("ppos"))
    texts = element_texts(stream, all_paths, key)
    el = el.join(texts, [key, "pos"], "left").withColumn("inner_text", tx.text("inner_text"))
    # the previous sibling comes from the row before; of a parent's children only the first three and the first six with text are kept
    line = Window.partitionBy(key, "ppos").orderBy("pos")
    has = F.col("inner_text") != ""
    el = el.withColumn("prev", F.when(F.col("ppos").isNotNull(), F.lag(F.substring("inner_text", 1, 40)).over(line)))
    kin = el.filter("ppos is not null").select(key, "ppos", "pos", F.concat("tag", F.lit(":"), F.substring("inner_text", 1, 25)).alias("t"), has.alias("has"),
                                               F.row_number().over(line).alias("r"), F.sum(has.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("rt"))
    entry = F.struct(F.col("pos").alias("kpos"), F.when(F.col("has"), F.col("t")).alias("t"))
    family = kin.filter("r <= 3 or (has and rt <= 6)").groupBy(key, "ppos").agg(
        F.array_sort(F.collect_list(F.when(F.col("r") <= 3, entry))).alias("kids"), F.array_sort(F.collect_list(F.when(F.col("has") & (F.col("rt") <= 6), entry))).alias("near"))
    me = matched.join(el.select(key, "pos", "tag", "attrs", "ppos", "prev"), [key, "pos"]).select(
        key, "cand_pos", "pos", "tag", "ppos", "prev", html_attr(a, "id").alias("own_id"), html_attr(a, "aria-labelledby").alias("lby"))

    ids = ("cand_pos",)
    who = [key, *ids]
    lab = el.filter("lower(tag) = 'label'").select(key, html_attr(a, "for").alias("own_id"), F.struct("pos", F.substring("inner_text", 1, 50).alias("t")).alias("x")).filter("own_id <> ''")
    by_for = me.filter("own_id <> ''").join(lab, [key, "own_id"]).groupBy(*who).agg(F.min("x").alias("x")).select(*who, F.col("x.t").alias("label_for"))
    ref = el.select(key, html_attr(a, "id").alias("lby"), F.struct("pos", F.substring("inner_text", 1, 50).alias("t")).alias("x")).filter("lby <> ''")
    by_ref = me.filter("lby <> ''").join(ref, [key, "lby"]).groupBy(*who).agg(F.min("x").alias("x")).select(*who, F.col("x.t").alias("label_by"))

    others = F.slice(F.filter("near", lambda x: x["kpos"] != F.col("pos")), 1, 5)
    child = family.select(key, F.col("ppos").alias("pos"), "kids")
    par = el.select(key, F.col("pos").alias("ppos"), F.lower("tag").alias("ptag"), F.substring(first_filled(html_attr(a, "aria-label"), html_attr(a, "role")), 1, 25).alias("prole"))
    d = (me.join(family.select(key, "ppos", "near"), [key, "ppos"], "left").withColumn("near", others).join(child, [key, "pos"], "left")
         .join(by_for, who, "left").join(by_ref, who, "left").join(par, [key, "ppos"], "left"))
    label = first_filled(tx.text("label_for"), tx.text("label_by"))
    rooted = F.col("ptag").isNull() | F.col("ptag").isin(*ROOTS)
    listed = lambda c: F.array_join(F.filter(F.transform(c, lambda s: s["t"]), lambda t: t.isNotNull()), ", ")
    boxed = lambda name, t: F.when(t != "", F.concat(F.lit(f"{name}:["), t, F.lit("]")))
    parts = [F.when(label != "", F.concat(F.lit("label:"), label)).when(tx.text("prev") != "", F.concat(F.lit("prev:"), "prev")),
             F.when(F.col("ptag").isin(*CONTAINERS), F.concat(F.lit("in:<"), "ptag", F.when(F.col("prole") != "", F.concat(F.lit("["), "prole", F.lit("]"))).otherwise(""), F.lit(">"))),
             boxed("children", tx.text(listed(F.col("kids")))), F.when(~rooted, boxed("near", tx.text(listed(F.col("near")))))]
    return d.select(*who, F.concat_ws(" | ", *parts).alias("context"))


# ---------------------------------------------------------------- one table of elements

def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int = 60) -> DataFrame:
    """(key, els): the open tags of a page in order, as nested intervals, in one row per page.

    An element holds the elements and texts whose position lies between its own and its `leave`, so ancestors, containment
    and distance are tests on numbers inside the row. `inner` is the first `limit` characters of its text. One exchange.
    """
    d = tag_stream(pages, key, html, void_leaf=True)
    a = F.col("attrs")
    # a text behind a close tag belongs to what is still open there; one behind a leaf to nothing
    held = (F.col("text") != "") & (F.col("closes") & (F.col("depth") > 0) | (F.col("step") == 1))
    line = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_t", F.when(held, F.col("text"))).withColumn("_n", F.count("_t").over(line) - F.col("_t").isNotNull().cast("int"))
    # at one depth an open tag is followed by its own close tag
    level = Window.partitionBy(key, "depth", F.col("step") == 0).orderBy("pos")
    d = d.withColumn("leave", F.when(F.col("step") == 0, F.col("pos") + 1).otherwise(F.lead("pos").over(level))).withColumn("_end", F.lead("_n").over(level))
    role = html_attr(a, "role")
    el = F.struct("pos", "depth", F.coalesce("leave", F.lit(2**31 - 1)).alias("leave"), "tag", html_attr(a, "id").alias("id"), html_attr(a, "name").alias("name"), html_attr(a, "placeholder").alias("placeholder"),
                  html_attr(a, "aria-label").alias("aria"), role.alias("role"), F.substring(html_attr(a, "class"), 1, 30).alias("cls"), F.col("_n").alias("from"), F.when(F.col("step") == 0, F.col("_n")).otherwise(F.col("_end")).alias("to"))
    rows = d.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("closes"), el))).alias("els"), F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("pos", "_t")))).alias("_texts"))
    rows = pin(rows.withColumn("_texts", F.transform("_texts", lambda t: t["_t"])), "els", "_texts")

    def whole(e: Column) -> Column:
        n = F.coalesce(e["to"].cast("int"), F.size("_texts")) - e["from"].cast("int")
        inner = F.substring(F.array_join(F.slice("_texts", e["from"].cast("int") + 1, F.least(n, F.lit(limit))), ""), 1, limit)
        return F.struct(*[e[c].alias(c) for c in ("pos", "depth", "leave", "tag", "id", "name", "placeholder", "aria", "role", "cls")], inner.alias("inner"))

    return pin(rows.select(key, F.transform("els", whole).alias("els")), "els")


def path_of(els: Column, pos: Column) -> Column:
    """Ancestors of the element at `pos`, outermost first, then itself: array<struct<level,pos,tag,hint>>."""
    here = F.filter(els, lambda e: (e["pos"] <= pos) & ((e["pos"] == pos) | (e["leave"] > pos)))
    return F.transform(here, lambda e: F.struct(e["depth"].alias("level"), e["pos"].alias("pos"), e["tag"].alias("tag"), first_filled(e["id"], e["aria"], e["role"]).alias("hint")))


def element_of(els: Column, c: Column) -> Column:
    """Position of the page element of a candidate struct (tag, begin of the text, id, name, placeholder, aria), by the rule of `match_elements`."""
    same = lambda a, b: (b != "") & (a == b)

    def rank(e: Column) -> Column:
        trust = F.when(same(e["id"], c["id"]), 0).when(same(e["name"], c["name"]), 1).when(same(e["placeholder"], c["placeholder"]), 2).when(same(e["aria"], c["aria"]), 3).when(same(e["inner"], c["text"]), 9)
        return F.struct(trust.alias("trust"), e["pos"].alias("pos"))

    found = F.filter(F.transform(F.filter(els, lambda e: e["tag"] == c["tag"]), rank), lambda m: m["trust"].isNotNull())
    return F.array_min(found)["pos"]


def with_places(df: DataFrame, key: str = "id", html: str = "cleaned_html") -> DataFrame:
    """Adds `places`, array<struct<cand_pos,path>> of the candidates found in the decision's page, and the page's `els`.

    Equal pages are taken apart once, however many decisions show them; the elements then go to the decisions, and everything
    else is done in their rows.
    """
    d = df.withColumn("_page", F.md5(tx.text(html)))
    pages = d.groupBy("_page").agg(F.first(html).alias("_html"))
    d = d.join(page_elements(pages, "_page", "_html"), "_page", "left").drop("_page")
    known = F.transform("cands", lambda c, i: F.element_at(F.transform(F.array(ps.attr_pairs(c["attrs"])), lambda p: F.struct(
        i.cast("int").alias("cand_pos"), c["tag"].alias("tag"), F.substring(tx.strip(tx.text(c["text"])), 1, 60).alias("text"), *[ps.pair(p, k).alias(n) for k, n in zip(MATCH_KEYS, ("id", "name", "placeholder", "aria"))])), 1))
    d = pin(d.withColumn("_c", known), "_c")
    at = F.transform("_c", lambda c: F.struct(c["cand_pos"].alias("cand_pos"), element_of(F.col("els"), c).alias("pos")))
    d = pin(d.withColumn("_at", F.filter(at, lambda m: m["pos"].isNotNull())), "_at")
    places = F.transform("_at", lambda m: F.struct(m["cand_pos"].alias("cand_pos"), path_of(F.col("els"), m["pos"]).alias("path")))
    return pin(d.withColumn("places", F.coalesce(places, F.filter(F.array(F.struct(F.lit(0).alias("cand_pos"), path_of(F.col("els"), F.lit(0)).alias("path"))), lambda x: F.lit(False)))), "places").drop("_c", "_at")


def clean_html(pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = KEPT_ATTRS) -> DataFrame:
    """Pages without script and style blocks; tags keep only the listed attributes. Stays inside the row."""
    bare = ps.drop_script_style(html)
    # tags and the text between them, in order: text before the first tag, then tag and following text
    pieces = F.regexp_extract_all(bare, F.lit(r"<[^>]*>[^<]*|^[^<]+"), F.lit(0))

    def clean(p: Column) -> Column:
        shape = r"(?s)^<(/?[\p{L}][^\s/>]*)([^>]*?)(/?)>(.*)$"
        attrs = F.regexp_extract(p, shape, 2)
        found = F.filter(F.array(*[F.struct(F.regexp_instr(attrs, F.lit(rf"(?i)(?:^|\s){k}(?=[\s=]|$)")).alias("at"), F.lit(k).alias("k"), html_attr(attrs, k).alias("v")) for k in keep]), lambda s: s["at"] > 0)
        shown = F.array_join(F.transform(F.array_sort(found), lambda s: F.concat(F.lit(" "), s["k"], F.lit('="'), s["v"], F.lit('"'))), "")
        out = F.concat(F.lit("<"), F.regexp_extract(p, shape, 1), shown, F.regexp_extract(p, shape, 3), F.lit(">"), F.regexp_extract(p, shape, 4))
        return F.when(p.rlike(shape), out).otherwise(p)

    return pages.select(key, F.array_join(F.transform(pieces, clean), "").alias("clean"))


def strip_scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, ps.drop_script_style(html).alias("clean"))


# ---------------------------------------------------------------- tree list of candidates

# Attributes shown for a candidate, in full and short lists.
TREE_ATTRS = ("id", "name", "type", "role", "aria-label", "placeholder", "value", "href", "for", "label", "options")
LIST_ATTRS_COMPACT = ("type", "name", "aria-label", "placeholder", "label", "options", "role")


def format_tree(df: DataFrame, key: str = "id", compact: bool = False) -> DataFrame:
    """(key, tree): indented list of the matched candidates below their ancestors, one text per decision with any.

    ``df`` has cands, places and els (see `with_places`). Lines come in page order; an ancestor shows tag, id, class and role, a
    candidate its number and attributes; of candidates at one element the first one shows.
    """
    d = pin(df.select(key, "els", "cands", F.transform("places", lambda p: F.struct(p["cand_pos"].alias("cand_pos"), F.concat(above(p["path"]), F.slice(p["path"], -1, 1)).alias("path"))).alias("_p")).filter(F.size("_p") > 0), "_p")
    chain = F.array_sort(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.transform(p["path"], lambda n, i: F.struct(n["pos"].alias("pos"), i.alias("indent")))))))
    d = pin(d.withColumn("_chain", chain).withColumn("_lines", F.transform("cands", lambda c, i: tree_line(c, i, compact))), "_chain", "_lines")
    opt = lambda label, v: F.when(v != "", F.concat(F.lit(f" {label}="), v)).otherwise("")

    def show(n: Column) -> Column:
        e = F.element_at(F.filter("els", lambda x: x["pos"] == n["pos"]), 1)
        mine = F.array_min(F.transform(F.filter("_p", lambda p: F.element_at(p["path"], -1)["pos"] == n["pos"]), lambda p: p["cand_pos"]))
        plain = lambda x: F.concat(F.lit("<"), x["tag"], opt("id", x["id"]), opt("class", x["cls"]), opt("role", F.substring(first_filled(x["role"], x["aria"]), 1, 30)), F.lit(">"))
        return F.concat(F.repeat(F.lit("  "), n["indent"].cast("int")), F.coalesce(F.element_at("_lines", mine + 1), plain(e)))

    return d.select(key, F.array_join(F.transform("_chain", show), "\n").alias("tree"))


def tree_line(c: Column, at: Column, compact: bool) -> Column:
    """Line of candidate struct `c` at 0-based position `at`."""
    def line(p: Column) -> Column:
        back = F.filter(F.transform(F.array(*[F.lit(k) for k in ("aria-label", "placeholder", "title", "role", "name")]),
                                    lambda k: F.struct(k.alias("k"), F.try_element_at(F.filter(p, lambda x: (x["k"] == k) & (x["v"] != "")), F.lit(-1))["v"].alias("v"))), lambda s: s["v"].isNotNull())
        alt = F.try_element_at(back, F.lit(1))
        t = tx.strip(tx.text(c["text"]))
        shown = F.when(t != "", t).when(alt.isNotNull(), F.concat(F.lit("["), alt["k"], F.lit(":"), F.substring(alt["v"], 1, 30), F.lit("]"))).otherwise("")
        keys = LIST_ATTRS_COMPACT if compact else TREE_ATTRS
        parts = F.filter(F.array(*[F.when(ps.pair(p, k) != "", F.concat(F.lit(f"{k}="), F.substring(ps.pair(p, k), 1, 50))) for k in keys]), lambda x: x.isNotNull())
        return F.concat(F.lit("["), (at + 1).cast("string"), F.lit("] <"), c["tag"], F.lit(">"), F.when(shown != "", F.concat(F.lit(" '"), F.substring(shown, 1, 50), F.lit("'"))).otherwise(""),
                        F.when(F.size(parts) > 0, F.concat(F.lit(" | "), F.array_join(parts, " | "))).otherwise(""))

    return F.element_at(F.transform(F.array(ps.attr_pairs(c["attrs"])), line), 1)
