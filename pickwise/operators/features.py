"""Feature matrices: op classifier rows, first-generation candidate features, 37-column candidate matrix."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import parse as ps, text as tx
from ..session import materialize, pin, stack
from . import profile as pf, rank as rk, tfidf
from .rows import explode_candidates

# Tag columns and tag groups of the feature matrices.
TAGS = ("a", "button", "input", "select", "textarea", "div", "span", "li", "option", "label", "p", "img", "form", "h1", "h2", "h3", "h4", "ul")
CLICK_TAGS = ("a", "button", "div", "span", "li", "img", "p", "h1", "h2", "h3", "h4")
TYPE_TAGS = ("input", "textarea")
SELECT_TAGS = ("select",)
WORD_FEATURES, CHAR_FEATURES = 8000, 8000


def flag(c: Column) -> Column:
    return c.cast("int")


def row_features(df: DataFrame, *beside: Column | str) -> DataFrame:
    """14 text features and count/presence of 18 tags per decision, and what stands ``beside`` them; no shuffle."""
    d = df.withColumn("_tags", F.transform("cands", lambda c: c["tag"]))
    n = {t: F.size(F.filter("_tags", lambda x: x == t)) for t in TAGS}
    return d.select("id", F.size("_tags").alias("n_cands"), *[c.alias(k) for k, c in tx.text_stats().items()],
                    *[c.alias(f"cand_n_{t}") for t, c in n.items()], *[flag(F.exists("_tags", lambda x: x == t)).alias(f"cand_has_{t}") for t in TAGS], *beside)


ROW_FEATURES = ("n_cands", *("task_len task_words hist_len hist_words task_has_dquote task_has_squote task_has_digit task_kw_type "
                "task_kw_select task_kw_click hist_n_type hist_n_select hist_n_click").split(),
                *[f"cand_n_{t}" for t in TAGS], *[f"cand_has_{t}" for t in TAGS])


def candidate_frame(df: DataFrame, with_label: bool = True, keep: Sequence[str] = ("id", "task", "history")) -> DataFrame:
    """Exploded candidates with the parsed history beside them.

    Word sets of the row are built before the explode, once per decision.
    """
    d = df.withColumn("_steps", ps.history_steps("history"))
    s = F.col("_steps")
    d = d.select("*", F.size(s).alias("hist_n_steps"), ps.last_step(s, "tag").alias("last_tag"), ps.last_step(s, "op").alias("last_op"),
                 tx.word_set("task").alias("_task"), tx.word_set("history").alias("_hist"),
                 tx.word_set(ps.last_step(s, "text")).alias("_last"), tx.word_set(ps.joined_steps(s, "text")).alias("_texts"))
    cols = [*keep, "hist_n_steps", "last_tag", "last_op", "_task", "_hist", "_last", "_texts"]
    return explode_candidates(d, with_label, cols)


BASE_FEATURES = tuple([f"tag_{t}" for t in TAGS] + ["cand_pos_rel", "text_len", "attrs_len", "has_aria", "has_role", "has_alt", "has_text"])
OVERLAP_FEATURES = ("ovl_task_text", "ovl_task_attrs", "ovl_hist_text", "cov_task_text", "cov_task_attrs", "ovl_lasttext_text", "ovl_histtext_text", "cov_task_minus_hist_text")
LAST_FEATURES = ("same_tag_as_last", "last_op_CLICK", "last_op_TYPE", "last_op_SELECT")


def cand_base(cand: DataFrame) -> DataFrame:
    has = lambda s: flag(F.col("attrs").contains(s))
    return cand.select("*", *[flag(F.col("tag") == t).alias(f"tag_{t}") for t in TAGS],
                       (F.col("cand_pos") / F.greatest("n_cands", F.lit(1))).alias("cand_pos_rel"),
                       F.length("text").alias("text_len"), F.length("attrs").alias("attrs_len"), has("aria_label").alias("has_aria"),
                       has("role=").alias("has_role"), has("alt=").alias("has_alt"), flag(F.length("text") > 0).alias("has_text"))


def cand_overlap(cand: DataFrame) -> DataFrame:
    d = cand.withColumn("_tw", tx.word_set("text")).withColumn("_aw", tx.word_set("attrs"))
    t, a, task, hist, last, texts = (F.col(c) for c in ("_tw", "_aw", "_task", "_hist", "_last", "_texts"))
    return d.select("*", tx.overlap_ratio(task, t).alias("ovl_task_text"), tx.overlap_ratio(task, a).alias("ovl_task_attrs"),
                    tx.overlap_ratio(hist, t).alias("ovl_hist_text"), tx.coverage(task, t).alias("cov_task_text"), tx.coverage(task, a).alias("cov_task_attrs"),
                    tx.overlap_ratio(last, t).alias("ovl_lasttext_text"), tx.overlap_ratio(texts, t).alias("ovl_histtext_text"),
                    tx.remaining_overlap(task, texts, t).alias("cov_task_minus_hist_text")).drop("_tw", "_aw")


def cand_last(cand: DataFrame) -> DataFrame:
    return cand.select("*", flag(F.col("tag") == F.col("last_tag")).alias("same_tag_as_last"),
                       *[flag(F.col("last_op") == o).alias(f"last_op_{o}") for o in ("CLICK", "TYPE", "SELECT")])


def cosine_vocabs(df: DataFrame, folds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Word and character vocabularies fitted on candidate texts and, once per candidate, the task.

    With `folds`, `df` has `fold`, and the vocabularies are those of all folds (see `tfidf.fit_folds`).
    """
    more = ["fold"] if folds else []
    elem = explode_candidates(df, False, ("id", *more)).select("id", "cand_pos", *more, _elem().alias("_e"))
    task = df.filter(F.size("cands") > 0).select("id", F.lit(-1).alias("cand_pos"), *more, "task", F.size("cands").alias("_n"))
    docs = lambda f: stack(elem.select("id", "cand_pos", *more, F.lit(1).alias("n"), f("_e").alias("terms")),
                           task.select("id", "cand_pos", *more, F.col("_n").alias("n"), f("task").alias("terms")))
    if folds:
        return tuple(tfidf.fit_folds(docs(f), ("terms",), folds, size, 2, "n") for f, size in ((tfidf.word_terms, WORD_FEATURES), (tfidf.char_terms, CHAR_FEATURES)))
    word = tfidf.fit(docs(tfidf.word_terms), ("id", "cand_pos"), ("terms",), WORD_FEATURES, 2, "n")
    char = tfidf.fit(docs(tfidf.char_terms), ("id", "cand_pos"), ("terms",), CHAR_FEATURES, 2, "n")
    return word, char


def _elem() -> Column:
    return F.concat(F.col("text"), F.lit(" "), F.col("attrs"))


def cand_cosine(cand: DataFrame, word: DataFrame, char: DataFrame, folds: int | None = None) -> DataFrame:
    """cos_w_task_elem, cos_w_hist_elem, cos_c_task_elem per (id, cand_pos); with `folds` one of each per fold, ending in its number.

    A candidate's terms are counted in its row. Only ids that repeat are shuffled, as their rows are counted together.
    """
    cand = cand.filter("id is not null")
    again = materialize(cand.filter("cand_pos = 0").groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    keys, words = ("id", "cand_pos"), {"we": _elem(), "wt": "task", "wh": "history"}
    docs = cand.join(again, "id", "left_anti").select(*keys, *[tfidf.word_terms(c).alias(n) for n, c in words.items()], tfidf.char_terms(_elem()).alias("ce"), tfidf.char_terms("task").alias("ct"))
    out = tfidf.cosine_in_row(docs, keys, (("we", (("wt", "cos_w_task_elem"), ("wh", "cos_w_hist_elem")), word), ("ce", (("ct", "cos_c_task_elem"),), char)), folds)
    return out if again.isEmpty() else stack(out, _shuffled_cosine(cand.join(again, "id", "left_semi"), word, char, folds))


def _shuffled_cosine(cand: DataFrame, word: DataFrame, char: DataFrame, folds: int | None) -> DataFrame:
    w = tfidf.cosine(cand.select("id", "cand_pos", tfidf.word_terms(_elem()).alias("e"), tfidf.word_terms("task").alias("t"), tfidf.word_terms("history").alias("h")),
                     ("id", "cand_pos"), "e", ("t", "h"), word, folds)
    c = tfidf.cosine(cand.select("id", "cand_pos", tfidf.char_terms(_elem()).alias("e"), tfidf.char_terms("task").alias("t")),
                     ("id", "cand_pos"), "e", ("t",), char, folds)
    ends = [""] if folds is None else [f"_{i}" for i in range(folds)]
    return w.select("id", "cand_pos", *[F.col(f"cos_{o}{e}").alias(f"cos_w_{n}_elem{e}") for o, n in (("t", "task"), ("h", "hist")) for e in ends]).join(
        c.select("id", "cand_pos", *[F.col(f"cos_t{e}").alias(f"cos_c_task_elem{e}") for e in ends]), ["id", "cand_pos"])


def cand_affinity(cand: DataFrame, probs: DataFrame, priors: DataFrame, default: float = 1e-4) -> DataFrame:
    """Op probabilities against tag groups and tag priors. `cand` has tag and tag_count.

    The priors become one row per tag, so a single lookup serves all ops.
    """
    wide = priors.groupBy("tag").agg(*[F.max(F.when(F.col("op") == o, F.col("prior"))).alias(f"_{o}") for o in ("CLICK", "TYPE", "SELECT")])
    d = cand.join(probs, "id").join(wide, "tag", "left")
    p = {"CLICK": F.col("p_click"), "TYPE": F.col("p_type"), "SELECT": F.col("p_select")}
    groups = {"CLICK": CLICK_TAGS, "TYPE": TYPE_TAGS, "SELECT": SELECT_TAGS}
    match = sum((p[o] * F.col("tag").isin(*g).cast("double") for o, g in groups.items()), F.lit(0.0))
    d = d.select("*", match.alias("op_tag_match"), *[F.coalesce(F.col(f"_{o}"), F.lit(default)).alias(f"tag_prior_{o.lower()}") for o in p])
    mix = sum((p[o] * F.col(f"tag_prior_{o.lower()}") for o in p), F.lit(0.0))
    return (d.withColumn("tag_prior_mix", mix).withColumn("tag_prior_mix_norm", F.col("tag_prior_mix") / F.greatest("tag_count", F.lit(1)))
            .drop("_CLICK", "_TYPE", "_SELECT"))


NORMED = ("cos_w_task_elem", "cos_w_hist_elem", "cos_c_task_elem", "ovl_task_text", "cov_task_text")
V1_FEATURES = (BASE_FEATURES + ("cand_pos", "n_cands", "hist_n_steps") + OVERLAP_FEATURES + LAST_FEATURES + NORMED[:3]
               + tuple(f"{c}_{k}" for c in NORMED for k in ("rank", "z", "fmax"))
               + ("tag_count", "tag_unique", "p_click", "p_type", "p_select", "op_tag_match", "tag_prior_click", "tag_prior_type", "tag_prior_select",
                  "tag_prior_mix", "tag_prior_mix_norm"))


def features_v1(df: DataFrame, probs: DataFrame, priors: DataFrame, vocabs: tuple[DataFrame, DataFrame], with_label: bool = True) -> DataFrame:
    """All first-generation candidate features (long frame)."""
    cand = candidate_frame(df, with_label)
    d = cand_last(cand_overlap(cand_base(cand))).join(cand_cosine(cand, *vocabs), ["id", "cand_pos"])
    return _v1_rest(d, probs, priors, ("id", "candidate_id", *(["is_target"] if with_label else [])))


def _v1_rest(d: DataFrame, probs: DataFrame, priors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """What of the first-generation features needs the cosines, the op probabilities or the other candidates."""
    d = rk.with_tag_count(rk.group_norm(d, NORMED))
    return cand_affinity(d, probs, priors).select(*keep, *V1_FEATURES)


def features_v1_folds(df: DataFrame, vocabs: tuple[DataFrame, DataFrame], folds: int) -> DataFrame:
    """The part of the features that is worked out once for all folds: `df` has `fold`; cosines end in the fold's number."""
    cand = candidate_frame(df, True, ("id", "fold", "task", "history"))
    drop = ("task", "history", "text", "attrs", "_task", "_hist", "_last", "_texts")
    return cand_last(cand_overlap(cand_base(cand))).drop(*drop).join(cand_cosine(cand, *vocabs, folds), ["id", "cand_pos"])


def features_v1_of(shared: DataFrame, fold: int, folds: int, probs: DataFrame, priors: DataFrame) -> DataFrame:
    """All first-generation features for one fold, with `fold`, from the shared part."""
    cos = NORMED[:3]
    d = shared.withColumns({c: F.col(f"{c}_{fold}") for c in cos}).drop(*[f"{c}_{i}" for c in cos for i in range(folds)])
    return _v1_rest(d, probs, priors, ("id", "fold", "candidate_id", "is_target"))


# ---------------------------------------------------------------- second generation

V2_FEATURES = (
    "inter_RC", "inter_TC", "sz_R", "sz_T", "sz_C", "cov_R_C", "cov_T_C", "cov_C_R", "jac_RC", "jac_TC", "dice_RC", "cov_R_C_idf", "cov_T_C_idf",
    "idf_inter_RC", "label_match_T", "name_match_T", "ph_match_T", "options_in_task", "n_options", "text_in_history", "label_in_history", "pos",
    "n_cands", "pos_norm", "n_history_steps", "tag_idx", "is_in_completed", "n_completed", "html_current_step", "html_total_steps",
    "html_step_remaining", "html_len_log", "input_type_idx", "in_workflow_panel", "n_panel_names", "h1_match_C", "ctx_match_T")


def task_history_idf(df: DataFrame) -> DataFrame:
    """Smooth IDF over the filtered tokens of task and history together."""
    return pf.idf_table(df.select(F.concat(tx.tokenize("task"), tx.tokenize("history")).alias("toks")), "toks")


def with_task_idf(df: DataFrame, idf: DataFrame, tokens: str = "t") -> DataFrame:
    """Adds `tidf`: the row's tokens with their IDF (1.0 when unknown), as array<struct<k,idf>>.

    Only (id, token) pairs meet the IDF table; adaptive execution broadcasts the table if it measures
    small and otherwise splits hot tokens.
    """
    pairs = df.select("id", F.explode_outer(tokens).alias("token")).filter("token is not null").join(idf.select("token", "idf"), "token", "left")
    lists = pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("token").alias("k"), F.coalesce("idf", F.lit(1.0)).alias("idf")))).alias("tidf"))
    return df.join(lists, "id", "left").withColumn("tidf", F.coalesce("tidf", F.expr("cast(array() as array<struct<k:string,idf:double>>)")))


def idf_sum(tidf: Column, *within: Column) -> Column:
    """IDF mass of the tokens that are in every given set."""
    kept = tidf
    for s in within:
        kept = F.filter(kept, lambda x: F.array_contains(s, x["k"]))
    return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["idf"])


def features_v2(df: DataFrame, idf: DataFrame, with_label: bool = True) -> DataFrame:
    """37-column candidate matrix, one row per candidate."""
    lead = ["id", "task", "history", "cands", *(["target_id"] if with_label else [])]
    d = df.filter(F.size("cands") > 0).select(*lead, ps.html_context("cleaned_html").alias("x"))
    d = d.withColumn("t", tx.token_set("task")).withColumn("h", tx.token_set("history")).withColumn("r", tx.remaining(F.col("t"), F.col("h")))
    d = with_task_idf(pin(d, "t", "h", "r"), idf)
    d = d.withColumn("r_sum", idf_sum(F.col("tidf"), F.col("r"))).withColumn("t_sum", idf_sum(F.col("tidf")))
    d = d.select("*", F.lower(tx.text("task")).alias("tl"), F.lower(tx.text("history")).alias("hl"), ps.n_steps("history").alias("n_history_steps"))
    row = ["t", "r", "tidf", "r_sum", "t_sum", "tl", "hl", "n_history_steps", "x"]
    c = explode_candidates(d, with_label, ["id", *row])
    c = c.select("*", tx.token_set(_elem()).alias("c"), *[ps.first_attr("attrs", k).alias(f"_{k}") for k in ("label", "name", "placeholder")],
                 ps.options("attrs", "/").alias("_opts"))
    c = c.select("*", tx.token_set("_label").alias("_lt"), tx.token_set(F.replace("_name", F.lit("_"), F.lit(" "))).alias("_nt"), tx.token_set("_placeholder").alias("_pt"),
                 tx.common(F.col("r"), F.col("c")).alias("inter_RC"), tx.common(F.col("t"), F.col("c")).alias("inter_TC"), idf_sum(F.col("tidf"), F.col("r"), F.col("c")).alias("idf_inter_RC"),
                 idf_sum(F.col("tidf"), F.col("c")).alias("_idf_TC"))
    t, r, cc, x = F.col("t"), F.col("r"), F.col("c"), F.col("x")
    irc, itc = F.col("inter_RC"), F.col("inter_TC")
    nr, nt, nc = F.size(r), F.size(t), F.size(cc)
    inside = lambda text_, arr: (text_ != "") & F.array_contains(arr, text_)
    low = lambda n: F.lower(tx.strip(n))
    cols = {
        "inter_RC": irc, "inter_TC": itc, "sz_R": nr, "sz_T": nt, "sz_C": nc,
        "cov_R_C": tx.ratio(irc, nr), "cov_T_C": tx.ratio(itc, nt), "cov_C_R": tx.ratio(irc, nc),
        "jac_RC": tx.ratio(irc, nr + nc - irc), "jac_TC": tx.ratio(itc, nt + nc - itc), "dice_RC": tx.ratio(2 * irc, nr + nc),
        "cov_R_C_idf": tx.ratio(F.col("idf_inter_RC"), F.col("r_sum")), "cov_T_C_idf": tx.ratio(F.col("_idf_TC"), F.col("t_sum")), "idf_inter_RC": F.col("idf_inter_RC"),
        "label_match_T": tx.overlap_ratio(t, F.col("_lt")), "name_match_T": tx.overlap_ratio(t, F.col("_nt")), "ph_match_T": tx.overlap_ratio(t, F.col("_pt")),
        "options_in_task": F.size(F.filter("_opts", lambda o: F.contains(F.col("tl"), F.lower(o)))), "n_options": F.size("_opts"),
        "text_in_history": flag((F.col("text") != "") & F.contains(F.col("hl"), F.lower("text"))),
        "label_in_history": flag((F.col("_label") != "") & F.contains(F.col("hl"), F.lower("_label"))),
        "pos": F.col("cand_pos"), "n_cands": F.col("n_cands"), "pos_norm": F.col("cand_pos") / F.greatest(F.lit(1), F.col("n_cands") - 1),
        "n_history_steps": F.col("n_history_steps"), "tag_idx": tx.vocab_index("tag", tx.TAG_VOCAB),
        "is_in_completed": flag(inside(low("text"), x["completed"]) | inside(low("_label"), x["completed"])), "n_completed": F.size(x["completed"]),
        "html_current_step": x["cur_step"], "html_total_steps": x["tot_step"], "html_step_remaining": F.greatest(F.lit(0), x["tot_step"] - x["cur_step"]),
        "html_len_log": F.log1p(x["html_len"]), "input_type_idx": ps.input_type_index("attrs"), "in_workflow_panel": flag(inside(low("_name"), x["panel_names"])),
        "n_panel_names": F.size(x["panel_names"]), "h1_match_C": tx.overlap_ratio(cc, x["h1_tokens"]), "ctx_match_T": tx.overlap_ratio(t, x["ctx_tokens"]),
    }
    keep = ["id", "candidate_id", *(["is_target"] if with_label else [])]
    return c.select(*keep, *[cols[n].alias(n) for n in V2_FEATURES])


def idf_coverage(df: DataFrame, idf: DataFrame) -> DataFrame:
    """IDF-weighted coverage of task tokens and of open tokens per candidate."""
    d = with_task_idf(rk.with_token_sets(df.select("id", "task", "history", "cands")), idf)
    r, ti = F.col("r"), F.col("tidf")
    pairs = F.transform("ctoks", lambda c: F.struct(
        tx.ratio(idf_sum(ti, r, c), idf_sum(ti, r)).alias("open_cov"), tx.ratio(idf_sum(ti, c), idf_sum(ti)).alias("task_cov")))
    return d.select("id", F.posexplode_outer(pairs).alias("cand_pos", "p")).select("id", "cand_pos", "p.*")
