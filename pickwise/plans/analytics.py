"""Queries over features, TF-IDF, distributions, vocabularies, votes and key sets."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as ps, text as tx
from ..functions.stopwords import ENGLISH, PROFILE
from ..operators import features as ft, profile as pf, rows as rw, split as sp, tfidf as ti, votes as vt
from ..operators.rank import with_tag_count
from .basic import r6
from .registry import TRAIN_SITES, _stop_list, query, sql_common, sql_jaccard, sql_toks, sql_tokset, sql_wordset
from .scoring import BASE

# ---------------------------------------------------------------- idf and TF-IDF

_IDF = f"""
with it as (select id, list_concat({sql_toks('task')}, {sql_toks('history')}) as toks, {sql_tokset('task')} as t, {sql_tokset('history')} as h from decisions),
idf as (select token, count(*) as df, ln(((select count(*) from it)+1)::double/(count(*)+1))+1 as idf from (select unnest(list_distinct(toks)) as token from it) group by token)
"""


@query("q8_4_idf_table", _IDF + "select token, df, round(idf,6) as idf from idf")
def _(fx):
    return ft.task_history_idf(fx.decisions.select("task", "history")).withColumn("idf", r6("idf"))


@query("q8_4_idf_documents", f"""with t as (select {sql_tokset('text')} as s from documents)
select token, count(*) as df, round(ln(((select count(*) from t)+1)::double/(count(*)+1))+1,6) as idf from (select unnest(s) as token from t) group by token""", needs=None)
def _(fx):
    return pf.idf_table(fx.table("documents").select(tx.token_set("text").alias("s")), "s").withColumn("idf", r6("idf"))


_IDFCOV = _IDF + f""", tt as (select it.id, token, idf, list_contains(h, token) as done from (select id, h, unnest(t) as token from it) it join idf using (token)),
cc as (select d.id, cand_pos, {sql_tokset("text || ' ' || attrs")} as c from candidates c join decisions d on d.id = c.id)"""


@query("q5_9_idf_coverage", _IDFCOV + """select cc.id, cand_pos, case when coalesce(sum(idf) filter (where not done),0) = 0 then 0.0 else round(coalesce(sum(idf) filter (where not done and list_contains(c,token)),0)/sum(idf) filter (where not done),6) end as open_cov,
 round(coalesce(sum(idf) filter (where list_contains(c,token)),0)/sum(idf),6) as task_cov from cc join tt on tt.id=cc.id group by cc.id, cand_pos""")
def _(fx):
    d = fx.decisions.select("id", "task", "history", "cands")
    return ft.idf_coverage(d, ft.task_history_idf(d)).select("id", "cand_pos", r6("open_cov").alias("open_cov"), r6("task_cov").alias("task_cov"))


_WT = lambda e, stop=ENGLISH: rf"list_filter(regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: not list_contains({_stop_list(stop)}, x))"


def _bigrams(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i+1]))"


_TFIDF_DOCS = f"""
with w as (select doc_id, {_WT('text')} as w from documents), g as (select doc_id, {_bigrams('w')} as g from w),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(g) as term from g) group by doc_id, term),
vo as (select term, count(*) as df, sum(tf) as total, ln((1+(select count(*) from documents))::double/(1+count(*)))+1 as idf from tf group by term having count(*) >= 2 order by total desc, term limit 3000)
"""


@query("q5_12_tfidf_vocab", _TFIDF_DOCS + "select term, df, total::bigint as total, round(idf,6) as idf from vo", needs=None)
def _(fx):
    d = fx.table("documents").select("doc_id", ti.word_terms("text").alias("terms"))
    return ti.fit(d, ("doc_id",), ("terms",), 3000, 2).withColumn("idf", r6("idf"))


@query("q5_12_tfidf_weights", _TFIDF_DOCS + ", x as (select doc_id, term, tf*idf as w from tf join vo using (term)) select doc_id, term, round(w/sqrt(sum(w*w) over (partition by doc_id)),6) as weight from x", needs=None)
def _(fx):
    d = fx.table("documents").select("doc_id", ti.word_terms("text").alias("terms"))
    v = ti.fit(d, ("doc_id",), ("terms",), 3000, 2)
    return ti.weights(d, ("doc_id",), "terms", v).withColumn("weight", r6("weight"))


@query("q5_13_char_ngrams", r"""
with w as (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w from benchmark), p as (select item_id, ' ' || w || ' ' as w from w),
n as (select item_id, w, unnest(range(3, greatest(3, least(5, length(w)))+1)) as n from p), g as (select item_id, unnest(list_transform(range(1, greatest(length(w)-n+1,1)+1), lambda i: substr(w, i, n))) as term from n)
select term, count(*) as total, count(distinct item_id) as df, round(ln((1+(select count(*) from benchmark))::double/(1+count(distinct item_id)))+1,6) as idf from g group by term having count(distinct item_id) >= 2 order by total desc, term limit 1500""", needs=None)
def _(fx):
    d = fx.table("benchmark").select("item_id", ti.char_terms("text").alias("terms"))
    return ti.fit(d, ("item_id",), ("terms",), 1500, 2).select("term", "total", "df", r6("idf").alias("idf"))


_ALPHA = lambda e: f"list_filter(list_transform(regexp_extract_all({e}, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x)), lambda x: not list_contains({_stop_list(PROFILE)}, x))"


@query("q5_14_tfidf_cosine", f"""
with b as (select id, {_ALPHA('task')} as t, {_ALPHA('history')} as h from decisions where history <> ''),
tf as (select id, term, sum(a)::double as a, sum(b)::double as b from (select id, unnest(t) as term, 1 as a, 0 as b from b union all select id, unnest(h), 0, 1 from b) group by id, term),
vo as (select term, ln((1+2*(select count(*) from b))::double/(1+sum((a>0)::int)+sum((b>0)::int)))+1 as idf from tf group by term having sum((a>0)::int)+sum((b>0)::int) >= 2),
s as (select id, sum(a*b*idf*idf) as d, sum(a*a*idf*idf) as sa, sum(b*b*idf*idf) as sb from tf join vo using (term) group by id)
select b.id, case when coalesce(sa*sb,0) > 0 then round(d/sqrt(sa*sb),6) else 0.0 end as cosine from b left join s on s.id=b.id""")
def _(fx):
    d = fx.decisions.filter("history <> ''").select("id", tx.tokenize("task", PROFILE).alias("t"), tx.tokenize("history", PROFILE).alias("h"))
    v = ti.fit(d, ("id",), ("t", "h"), None, 2)
    return ti.cosine(d, ("id",), "t", ("h",), v).select("id", r6("cos_h").alias("cosine"))


# ---------------------------------------------------------------- feature matrices

_TAGSQL = ", ".join(f"cast(count(*) filter (where tag='{t}') as int) as cand_n_{t}, cast(count(*) filter (where tag='{t}') > 0 as int) as cand_has_{t}" for t in ft.TAGS)


def _row_stats():
    from .basic import _stats_sql
    return _stats_sql()


@query("q6_1_row_features", f"""with s as (select id, {_row_stats()} from decisions), c as (select id, cast(count(*) as int) as n_cands, {_TAGSQL} from candidates group by id)
select s.*, c.* exclude (id) from s join c on c.id=s.id""")
def _(fx):
    return ft.row_features(fx.decisions.select(*BASE))


@query("q6_2_cand_base", "select c.candidate_id, " + ", ".join(f"(tag='{t}')::int as tag_{t}" for t in ft.TAGS) + """, round(cand_pos::double/greatest(n_cands,1),6) as cand_pos_rel, cast(length(text) as int) as text_len, cast(length(attrs) as int) as attrs_len,
 contains(attrs,'aria_label')::int as has_aria, contains(attrs,'role=')::int as has_role, contains(attrs,'alt=')::int as has_alt, (length(text)>0)::int as has_text from candidates c join decisions d on d.id=c.id""")
def _(fx):
    c = ft.cand_base(rw.explode_candidates(fx.decisions, False))
    return c.select("candidate_id", *[r6(n).alias(n) if n == "cand_pos_rel" else n for n in ft.BASE_FEATURES])


_STEP = r"""with hp as (select id, generate_subscripts(string_split(history, ' | '), 1) as i, unnest(string_split(history, ' | ')) as s from decisions where history <> ''),
hs as (select id, i, regexp_extract(s, '\[([^\]]+)\]', 1) as tag, trim(regexp_extract(s, '\] (.*?) ?-> ', 1)) as text, regexp_extract(s, '-> (\w+)', 1) as op from hp),
hh as (select id, last(tag order by i) as last_tag, last(op order by i) as last_op, last(text order by i) as last_text, string_agg(text, ' ' order by i) as texts from hs group by id)"""


def _ovl(a, b):
    return f"case when len({a})=0 or len({b})=0 then 0.0 else round({sql_common(a, b)}::double/len({b}),6) end"


def _cov(a, b):
    return f"case when len({a})=0 then 0.0 else round({sql_common(a, b)}::double/len({a}),6) end"


@query("q6_3_cand_overlap", _STEP + f""", x as (select c.candidate_id, {sql_wordset('d.task')} as tk, {sql_wordset('d.history')} as hi, {sql_wordset("coalesce(hh.last_text,'')")} as la, {sql_wordset("coalesce(hh.texts,'')")} as te,
 {sql_wordset('c.text')} as tx, {sql_wordset('c.attrs')} as ax from candidates c join decisions d on d.id=c.id left join hh on hh.id=d.id),
 y as (select *, list_filter(tk, lambda z: not list_contains(te, z)) as rem from x)
select candidate_id, {_ovl('tk','tx')} as ovl_task_text, {_ovl('tk','ax')} as ovl_task_attrs, {_ovl('hi','tx')} as ovl_hist_text, {_cov('tk','tx')} as cov_task_text, {_cov('tk','ax')} as cov_task_attrs,
 {_ovl('la','tx')} as ovl_lasttext_text, {_ovl('te','tx')} as ovl_histtext_text, {_ovl('rem','tx')} as cov_task_minus_hist_text from y""")
def _(fx):
    c = ft.cand_overlap(ft.candidate_frame(fx.decisions.select(*BASE), False))
    return c.select("candidate_id", *[r6(n).alias(n) for n in ft.OVERLAP_FEATURES])


@query("q6_4_cand_last", _STEP + """select c.candidate_id, (tag=coalesce(last_tag,''))::int as same_tag_as_last, (coalesce(last_op,'')='CLICK')::int as last_op_CLICK, (coalesce(last_op,'')='TYPE')::int as last_op_TYPE,
 (coalesce(last_op,'')='SELECT')::int as last_op_SELECT from candidates c join decisions d on d.id=c.id left join hh on hh.id=d.id""")
def _(fx):
    return ft.cand_last(ft.candidate_frame(fx.decisions.select(*BASE), False)).select("candidate_id", *ft.LAST_FEATURES)


_CW = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> '')"


def _cosine_sql(kind):
    if kind == "word":
        docs = f"select c.id, cand_pos, {_WT('c.text || chr(32) || c.attrs')} as e, {_WT('d.task')} as t, {_WT('d.history')} as h from candidates c join decisions d on d.id=c.id"
        return f"cw0 as ({docs}), cw1 as (select id, cand_pos, {_bigrams('e')} as e, {_bigrams('t')} as t, {_bigrams('h')} as h from cw0)"
    grams = lambda e: (f"flatten(list_transform({_CW.format(e)}, lambda w: flatten(list_transform(range(3, greatest(3, least(5, length(w)+2))+1), "
                       f"lambda n: list_transform(range(1, greatest(length(w)+2-n+1,1)+1), lambda i: substr(' '||w||' ', i, n))))))")
    return f"cc1 as (select c.id, cand_pos, {grams('c.text || chr(32) || c.attrs')} as e, {grams('d.task')} as t, []::varchar[] as h from candidates c join decisions d on d.id=c.id)"


def _cosine_tail(p):
    return f"""{p}k as (select id, cand_pos, term, sum(e)::double as e, sum(t)::double as t, sum(h)::double as h from (select id, cand_pos, unnest(e) as term, 1 as e, 0 as t, 0 as h from {p}1 union all
 select id, cand_pos, unnest(t), 0, 1, 0 from {p}1 union all select id, cand_pos, unnest(h), 0, 0, 1 from {p}1) group by all),
{p}v as (select term, ln((1+2*(select count(*) from {p}1))::double/(1+sum((e>0)::int)+sum((t>0)::int)))+1 as idf from {p}k where e+t>0 group by term having sum((e>0)::int)+sum((t>0)::int) >= 2 order by sum(e)+sum(t) desc, term limit 8000),
{p}s as (select id, cand_pos, sum(e*t*idf*idf) as et, sum(e*h*idf*idf) as eh, sqrt(sum(e*e*idf*idf)) as ne, sqrt(sum(t*t*idf*idf)) as nt, sqrt(sum(h*h*idf*idf)) as nh from {p}k join {p}v using (term) group by id, cand_pos)"""


@query("q6_5_cand_cosine", "with " + _cosine_sql("word") + ", " + _cosine_tail("cw") + ", " + _cosine_sql("char") + ", " + _cosine_tail("cc") + """
select c.id, c.cand_pos, case when coalesce(w.ne*w.nt,0)>0 then round(w.et/(w.ne*w.nt),5) else 0.0 end as cos_w_task_elem, case when coalesce(w.ne*w.nh,0)>0 then round(w.eh/(w.ne*w.nh),5) else 0.0 end as cos_w_hist_elem,
 case when coalesce(x.ne*x.nt,0)>0 then round(x.et/(x.ne*x.nt),5) else 0.0 end as cos_c_task_elem from cw1 c left join cws w on w.id=c.id and w.cand_pos=c.cand_pos left join ccs x on x.id=c.id and x.cand_pos=c.cand_pos""")
def _(fx):
    d = fx.decisions.select("id", "task", "history", "cands")
    cand = rw.explode_candidates(d, False, ("id", "task", "history"))
    c = ft.cand_cosine(cand, *ft.cosine_vocabs(d))
    return c.select("id", "cand_pos", *[F.round(n, 5).alias(n) for n in ("cos_w_task_elem", "cos_w_hist_elem", "cos_c_task_elem")])


def _probs(fx):
    """Share of each op among the fold votes of a decision, standing in for a classifier."""
    p = lambda o: F.avg((F.col("op") == o).cast("double"))
    return fx.votes.groupBy("id").agg(p("CLICK").alias("p_click"), p("TYPE").alias("p_type"), p("SELECT").alias("p_select"))


_PRIOR = """with pr as (select o.op, t.tag, (count(x.id)+1)::double/(max(o.total)+max(t.n_tags)) as prior from (select unnest(['CLICK','TYPE','SELECT']) as op) q
 join (select op, count(*) as total from decisions group by op) o on o.op=q.op cross join (select tag, count(*) over () as n_tags from (select distinct tag from candidates)) t
 left join (select d.id, d.op, c.tag from decisions d join candidates c on c.id=d.id and c.candidate_id=d.target_id) x on x.op=o.op and x.tag=t.tag group by o.op, t.tag)"""


@query("q8_5_tag_priors", _PRIOR + " select op, tag, round(prior,6) as prior from pr")
def _(fx):
    return pf.tag_priors(rw.explode_candidates(fx.decisions, True, ("id", "op"))).withColumn("prior", r6("prior"))


@query("q6_6_cand_affinity", _PRIOR + """, pb as (select id, avg((op='CLICK')::int) as pc, avg((op='TYPE')::int) as pt, avg((op='SELECT')::int) as ps from votes group by id),
w as (select tag, max(prior) filter (where op='CLICK') as rc, max(prior) filter (where op='TYPE') as rt, max(prior) filter (where op='SELECT') as rs from pr group by tag)
select c.candidate_id, round(case when c.tag in ('input','textarea') then pt when c.tag='select' then ps else pc end,6) as op_tag_match, round(pc*rc+pt*rt+ps*rs,6) as tag_prior_mix,
 round((pc*rc+pt*rt+ps*rs)/count(*) over (partition by c.id, c.tag),6) as tag_prior_mix_norm from candidates c join pb on pb.id=c.id join w on w.tag=c.tag""", needs="decisions votes")
def _(fx):
    cand = rw.explode_candidates(fx.decisions, True, ("id", "op"))
    a = ft.cand_affinity(with_tag_count(cand), _probs(fx), pf.tag_priors(cand))
    return a.select("candidate_id", *[r6(n).alias(n) for n in ("op_tag_match", "tag_prior_mix", "tag_prior_mix_norm")])


_R = "list_filter(t, lambda x: not list_contains(h, x))"


@query("q6_7_features_v2", _IDF + f""", d as (select d.id, d.task, d.history, d.cleaned_html as hm, d.n_cands, d.target_id, it.t, list_filter(it.t, lambda x: not list_contains(it.h, x)) as r from decisions d join it on it.id=d.id),
x as (select id, regexp_extract(hm, '(?i)Completed:\\s*([^<\\n]+)', 1) as done, coalesce(try_cast(regexp_extract(hm,'(?i)step\\s+(\\d+)\\s+of\\s+(\\d+)',1) as int),0) as cur, coalesce(try_cast(regexp_extract(hm,'(?i)step\\s+(\\d+)\\s+of\\s+(\\d+)',2) as int),0) as tot, length(hm) as hl,
 lower(regexp_extract(hm,'(?is)<section[^>]*aria-label="current workflow panel"[^>]*>.*?\\bname="([^"]+)"',1)) as panel, {sql_tokset("array_to_string(regexp_extract_all(hm,'(?i)<h1[^>]*>([^<]+)</h1>',1),' ')")} as h1,
 {sql_tokset("array_to_string(regexp_extract_all(hm,'(?i)<aside[^>]*class=" + '"workflow-context"' + "[^>]*>([^<]+)</aside>',1),' ')")} as cx from d),
x2 as (select *, list_distinct(list_filter(list_transform(string_split(done,','), lambda z: lower(trim(z))), lambda z: z <> '')) as comp from x),
ti as (select id, list(token) as ks, list(idf) as vs, sum(idf) as ts, coalesce(sum(idf) filter (where open),0) as rs from (select d.id, token, list_contains(d.r, token) as open from (select id, r, unnest(t) as token from d) d) u join idf using (token) group by id),
c as (select c.*, {sql_tokset("text || ' ' || attrs")} as c, {sql_tokset('label')} as lt, {sql_tokset("replace(name,'_',' ')")} as nt, case when opts='' then []::varchar[] else list_transform(string_split(opts,'/'), lambda z: trim(z)) end as os from candidates c),
z as (select c.*, d.t, d.r, d.task, d.history, d.n_cands, d.target_id, {sql_common('d.r','c.c')} as irc, {sql_common('d.t','c.c')} as itc, x2.* exclude (id), ti.* exclude (id),
 coalesce(list_sum(list_transform(list_filter(list_zip(ks, vs), lambda p: list_contains(c.c, p[1]) and list_contains(d.r, p[1])), lambda p: p[2])),0) as irc_idf, coalesce(list_sum(list_transform(list_filter(list_zip(ks, vs), lambda p: list_contains(c.c, p[1])), lambda p: p[2])),0) as itc_idf
 from c join d on d.id=c.id join x2 on x2.id=c.id join ti on ti.id=c.id)
select candidate_id, (candidate_id=target_id)::int as is_target, irc::int as inter_RC, itc::int as inter_TC, len(r)::int as sz_R, len(t)::int as sz_T, len(c)::int as sz_C, {_cov('r','c')} as cov_R_C, {_cov('t','c')} as cov_T_C,
 {_cov('c','r')} as cov_C_R, round({sql_jaccard('r','c')},6) as jac_RC, round({sql_jaccard('t','c')},6) as jac_TC, round(2*irc::double/(len(r)+len(c)),6) as dice_RC, case when rs>0 then round(irc_idf/rs,6) else 0 end as cov_R_C_idf, round(itc_idf/ts,6) as cov_T_C_idf,
 round(irc_idf,6) as idf_inter_RC, {_ovl('t','lt')} as label_match_T, {_ovl('t','nt')} as name_match_T, 0.0::double as ph_match_T, len(list_filter(os, lambda o: contains(lower(task), lower(o))))::int as options_in_task, len(os)::int as n_options,
 (text<>'' and contains(lower(history), lower(text)))::int as text_in_history, contains(lower(history), lower(label))::int as label_in_history, cand_pos as pos, n_cands::int as n_cands, round(cand_pos::double/greatest(1,n_cands-1),6) as pos_norm,
 len(regexp_extract_all(history,'Step \\d+:'))::int as n_history_steps, cast(case tag when 'input' then 0 when 'textarea' then 1 when 'select' then 2 when 'button' then 3 when 'a' then 4 when 'div' then 7 else 10 end as int) as tag_idx,
 ((text<>'' and list_contains(comp, lower(text))) or list_contains(comp, lower(label)))::int as is_in_completed, len(comp)::int as n_completed, cur::int as html_current_step, tot::int as html_total_steps, greatest(0,tot-cur)::int as html_step_remaining,
 round(ln(1+hl),6) as html_len_log, 11::int as input_type_idx, (panel<>'' and lower(name)=panel)::int as in_workflow_panel, (panel<>'')::int as n_panel_names, {_ovl('c','h1')} as h1_match_C, {_ovl('t','cx')} as ctx_match_T from z""")
def _(fx):
    d = fx.decisions.select(*BASE, "cleaned_html")
    f = ft.features_v2(d, ft.task_history_idf(d)).drop("id")
    return f.select(*[r6(n).alias(n) if t == "double" else n for n, t in f.dtypes])


# ---------------------------------------------------------------- distributions

@query("q8_1_value_counts", "select op, count(*) as n, round(count(*)::double/sum(count(*)) over (),6) as share from decisions group by op")
def _(fx):
    return pf.value_counts(fx.decisions.select("op"), "op").withColumn("share", r6("share"))


@query("q8_1_value_counts_by_type", """select html_type, op, count(*) as n, round(count(*)::double/sum(count(*)) over (partition by html_type),6) as share from (select op, case when contains(cleaned_html,'workflow-context') or contains(cleaned_html,'completed-fields') then 'workflow' else 'real_web' end as html_type from decisions) group by 1,2""")
def _(fx):
    return pf.value_counts(rw.with_html_type(fx.decisions.select("op", "cleaned_html")), "op", ["html_type"]).withColumn("share", r6("share"))


@query("q8_2_distinct_stats", "select count(*) as rows, count(distinct task) as n_tasks, round((select avg(k) from (select count(distinct target_id) as k from decisions group by task)),6) as targets_mean, (select max(k) from (select count(distinct target_id) as k from decisions group by task)) as targets_max, count(distinct site_token) as n_sites from decisions")
def _(fx):
    return pf.distinct_stats(fx.decisions.select("task", "target_id", "site_token")).withColumn("targets_mean", r6("targets_mean"))


@query("q8_3_site_bias", """select site_token, count(*) filter (where op='CLICK') as CLICK, count(*) filter (where op='TYPE') as TYPE, count(*) filter (where op='SELECT') as "SELECT", count(*) as total, round(count(*) filter (where op='CLICK')::double/count(*),6) as click_ratio
 from decisions group by site_token having count(*) filter (where op='CLICK')::double/count(*) >= 0.5""")
def _(fx):
    return pf.site_bias(fx.decisions.select("site_token", "op"), 0.5).withColumn("click_ratio", r6("click_ratio"))


def _describe_sql(src, cols):
    one = lambda c: (f"select '{c}' as metric, count(v) as n, round(avg(v),6) as mean, round(quantile_cont(v,0.25),6) as p25, round(quantile_cont(v,0.5),6) as median, round(quantile_cont(v,0.75),6) as p75, round(quantile_cont(v,0.95),6) as p95, "
                     f"round(max(v),6) as max, round(avg((v>=0.5)::int),6) as ge_05, round(avg((v>=0.3)::int),6) as ge_03, round(avg((v is null)::int),6) as empty_share from (select round({c}::double,6) as v from {src})")
    return " union all ".join(map(one, cols))


def _described(df):
    return df.select(*[r6(c).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("q8_6_quantiles", "select unnest([0.01, 0.25, 0.5, 0.75, 0.95, 0.999])::double as p, round(unnest(quantile_cont(l_extendedprice * (1 - l_discount), [0.01, 0.25, 0.5, 0.75, 0.95, 0.999])), 6) as value from lineitem", needs=None)
def _(fx):
    d = fx.table("lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return pf.quantiles(d, "v", (0.01, 0.25, 0.5, 0.75, 0.95, 0.999)).select("p", r6("value").alias("value"))


@query("q8_6_describe_metric", _describe_sql("decisions", ["n_cands", "length(task)", "length(value)"]).replace("'length(task)'", "'task_len'").replace("'length(value)'", "'value_len'"))
def _(fx):
    d = fx.decisions.select("n_cands", F.length("task").alias("task_len"), F.length("value").alias("value_len"))
    return _described(pf.describe_metric(d, d.columns))


@query("q8_7_vote", """with p as (select id, op, target_id, value, count(*) as n, min(fold) as f from votes group by all)
select id, op, target_id, value, n = 3 as unanimous from (select *, row_number() over (partition by id order by n desc, f) as rn from p) where rn=1""", needs="decisions votes")
def _(fx):
    return vt.vote(fx.votes, 3)


@query("q8_7_vote_unanimity", """with p as (select id, op, target_id, value, count(*) as n from votes group by all), m as (select o_orderkey as id, coalesce(max(n),0) = 3 as u from orders left join p on p.id=o_orderkey group by 1)
select count(*) as ids, count(*) filter (where u) as unanimous, round(avg(u::int),6) as rate from m""", needs="decisions votes")
def _(fx):
    ids = fx.table("orders").select(F.col("o_orderkey").alias("id"))
    return vt.unanimity(vt.vote(fx.votes, 3, ids)).withColumn("rate", r6("rate"))


@query("q3_11_vote_union", "select id, fold, op, target_id, value from votes", needs="decisions votes")
def _(fx):
    return vt.union_all(*[fx.votes.filter(F.col("fold") == k) for k in range(3)])


_TC = f"""with tc as (select token, sum(a)::bigint as n_a, sum(b)::bigint as n_b from (select unnest({sql_toks('task', PROFILE)}) as token, 1 as a, 0 as b from decisions where history<>'' union all
 select unnest({sql_toks('history', PROFILE)}), 0, 1 from decisions where history<>'') group by token)"""


def _counts(fx):
    d = fx.decisions.filter("history <> ''").select(tx.tokenize("task", PROFILE).alias("a"), tx.tokenize("history", PROFILE).alias("b"))
    return pf.token_counts(d, "a", "b")


@query("q8_8_top_tokens", _TC + " select token, n_a, n_b, round(n_a::double/(select sum(n_a) from tc),6) as freq_a, round(n_b::double/(select sum(n_b) from tc),6) as freq_b from tc order by n_a+n_b desc, token limit 25")
def _(fx):
    return _described(pf.top_tokens(_counts(fx)))


@query("q8_9_vocab_overlap", _TC + " select count(*) filter (where n_a>0) as vocab_a, count(*) filter (where n_b>0) as vocab_b, count(*) filter (where n_a>0 and n_b>0) as common, round(count(*) filter (where n_a>0 and n_b>0)::double/count(*),6) as jaccard from tc")
def _(fx):
    return _described(pf.vocab_overlap(_counts(fx)))


@query("q8_10_js_divergence", _TC + ", x as (select n_a::double/(select sum(n_a) from tc) as p, n_b::double/(select sum(n_b) from tc) as q from tc) select round((sum(case when p>0 then p*log2(p/((p+q)/2)) else 0 end)+sum(case when q>0 then q*log2(q/((p+q)/2)) else 0 end))/2,6) as js from x")
def _(fx):
    return _described(pf.js_divergence(_counts(fx)))


_DTC = f"""with tc as (select token, sum(a)::bigint as n_a, sum(b)::bigint as n_b from (select unnest({sql_toks('text', PROFILE)}) as token, 1 as a, 0 as b from conversations where role='user' union all
 select unnest({sql_toks('text', PROFILE)}), 0, 1 from conversations where role<>'user') group by token)"""


@query("q8_10_js_divergence_turns", _DTC + ", x as (select n_a::double/(select sum(n_a) from tc) as p, n_b::double/(select sum(n_b) from tc) as q from tc) select round((sum(case when p>0 then p*log2(p/((p+q)/2)) else 0 end)+sum(case when q>0 then q*log2(q/((p+q)/2)) else 0 end))/2,6) as js from x", needs=None)
def _(fx):
    t = fx.table("conversations").select("role", tx.tokenize("text", PROFILE).alias("k"))
    empty = F.expr("cast(array() as array<string>)")
    d = t.select(F.when(F.col("role") == "user", F.col("k")).otherwise(empty).alias("a"), F.when(F.col("role") != "user", F.col("k")).otherwise(empty).alias("b"))
    return _described(pf.js_divergence(pf.token_counts(d, "a", "b")))


@query("q8_11_exclusive_tokens", _TC + " (select 'task' as side, token, n_a as n from tc where n_b=0 order by n_a desc, token limit 10) union all (select 'history', token, n_b from tc where n_a=0 order by n_b desc, token limit 10)")
def _(fx):
    c = _counts(fx)
    one = lambda s, n: pf.exclusive_tokens(c, s).select(F.lit(n).alias("side"), "token", "n")
    return one("a", "task").unionByName(one("b", "history"))


_RS = f"""with tk as (select id, {sql_tokset('task', PROFILE)} as a, {sql_tokset('history', PROFILE)} as b from decisions where history <> ''),
rs as (select id, {sql_jaccard('a','b')} as jaccard, case when least(len(a),len(b))=0 then 0.0 else {sql_common('a','b')}::double/least(len(a),len(b)) end as overlap_min, case when len(a)+len(b)=0 then 0.0 else 2*{sql_common('a','b')}::double/(len(a)+len(b)) end as dice,
 {sql_common('a','b')} as inter, len(a)+len(b)-{sql_common('a','b')} as "union", len(a) as task_size, len(b) as history_size from tk)"""


@query("q8_13_histogram", _RS + " select least(floor(jaccard/(1.0/40)),39)::int as bin, count(*) as n from (select round(jaccard,9) as jaccard from rs) where jaccard between 0 and 1 group by 1")
def _(fx):
    s = pf.row_similarity(fx.decisions.select("id", "task", "history")).select(F.round("jaccard", 9).alias("jaccard"))
    return pf.histogram(s, "jaccard", 0.0, 1.0, 40)


@query("q8_13_histogram_int", "select n_cands::int as bin, count(*) as n from decisions group by 1")
def _(fx):
    return pf.histogram_int(fx.decisions.select("n_cands"), "n_cands")


@query("q8_13_histogram_p99", """with l as (select 'task_len' as metric, length(task) as v from decisions union all select 'history_len', length(history) from decisions), p as (select floor(quantile_cont(v,0.99)) as hi from l)
select metric, least(floor(v/(hi/60)),59)::int as bin, count(*) as n from l, p where v between 0 and hi group by 1,2""")
def _(fx):
    d = fx.decisions.select(F.length("task").alias("task_len"), F.length("history").alias("history_len"))
    return pf.histogram_to_p99(d, d.columns)


@query("q8_14_group_sizes", "select c.id, count(*) as n from candidates c join decisions d on d.id=c.id group by c.id")
def _(fx):
    return pf.group_sizes(rw.explode_candidates(fx.decisions, False))


# ---------------------------------------------------------------- profiles

_RAW = lambda c: f"len(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9_-]+'))"


@query("q12_12_length_profile", f"with x as (select length(task) as task_chars, length(history) as history_chars, {_RAW('task')} as task_words, {_RAW('history')} as history_words from decisions where history <> '') "
       + _describe_sql("x", ["task_chars", "history_chars", "task_words", "history_words"]))
def _(fx):
    return _described(pf.length_profile(fx.decisions.select("task", "history")))


@query("q12_13_row_similarity", _RS + ' select id, round(jaccard,6) as jaccard, round(overlap_min,6) as overlap_min, round(dice,6) as dice, "inter"::int as inter, "union"::int as "union", task_size::int as task_size, history_size::int as history_size from rs')
def _(fx):
    return _described(pf.row_similarity(fx.decisions.select("id", "task", "history")))


@query("q12_13_row_similarity_profile", _RS + " " + _describe_sql("rs", ["jaccard", "overlap_min", "dice"]))
def _(fx):
    return _described(pf.describe_metric(pf.row_similarity(fx.decisions.select("id", "task", "history")), ["jaccard", "overlap_min", "dice"]))


_RP = f"""with tk as (select id, {sql_tokset('task')} as t, {sql_tokset('history')} as h, target_id from decisions where history <> ''), rr as (select id, t, h, target_id, list_filter(t, lambda x: not list_contains(h, x)) as r from tk),
ca as (select c.id, candidate_id, {sql_tokset("text || ' ' || attrs")} as c from candidates c), al as (select id, list_distinct(flatten(list(c))) as a from ca group by id),
sc as (select ca.id, candidate_id = target_id as is_t, case when len(r)>0 then {sql_common('r','c')}::double/len(r) end as cov, case when len(r)>0 then {sql_jaccard('r','c')} end as jac from ca join rr on rr.id=ca.id),
ag as (select id, max(jac) filter (where is_t) as jac_target, max(cov) filter (where is_t) as cov_target, avg(jac) filter (where not is_t) as jac_others_mean, max(jac) filter (where not is_t) as jac_others_max, avg(cov) filter (where not is_t) as cov_others_mean, max(cov) filter (where not is_t) as cov_others_max from sc group by id),
tr as (select sc.id, count(*) filter (where not is_t and cov >= cov_target) + 1 as k from sc join ag on ag.id=sc.id group by sc.id),
rp as (select rr.id, len(t) as task_size, len(h) as history_size, len(r) as open_size, len(a) as cand_size, {sql_jaccard('r','a')} as jac_all, case when least(len(r),len(a))=0 then 0.0 else {sql_common('r','a')}::double/least(len(r),len(a)) end as ovl_all,
 case when len(r)+len(a)=0 then 0.0 else 2*{sql_common('r','a')}::double/(len(r)+len(a)) end as dice_all, case when len(r)>0 then {sql_common('r','a')}::double/len(r) end as cov_all, ag.* exclude (id), case when len(r)>0 then k end as target_rank_last from rr join al on al.id=rr.id join ag on ag.id=rr.id join tr on tr.id=rr.id)"""
_RPCOLS = ["jac_all", "ovl_all", "dice_all", "cov_all", "jac_target", "cov_target", "jac_others_mean", "jac_others_max", "cov_others_mean", "cov_others_max"]


@query("q12_14_remaining_scores", _RP + " select id, task_size::int as task_size, history_size::int as history_size, open_size::int as open_size, cand_size::int as cand_size, " + ", ".join(f"round({c},6) as {c}" for c in _RPCOLS) + ", target_rank_last::int as target_rank_last from rp")
def _(fx):
    return _described(pf.remaining_scores(fx.decisions.select(*BASE)))


@query("q12_14_remaining_profile", _RP + " " + _describe_sql("rp", _RPCOLS + ["target_rank_last"]))
def _(fx):
    return _described(pf.describe_metric(pf.remaining_scores(fx.decisions.select(*BASE)), _RPCOLS + ["target_rank_last"]))


# ---------------------------------------------------------------- key sets

@query("q15_1_key_except", f"select distinct site_token from decisions where site_token not in {TRAIN_SITES}")
def _(fx):
    d = fx.decisions.select("id", "site_token")
    return pf.key_except(d, sp.group_split(d).filter("not is_valid"), "site_token")


@query("q15_1_key_intersect", f"select distinct site_token from decisions where site_token in {TRAIN_SITES}")
def _(fx):
    d = fx.decisions.select("id", "site_token")
    return pf.key_intersect(d, sp.group_split(d).filter("not is_valid"), "site_token")


@query("q15_2_union_all", "select id, 'task' as side, task as text from decisions union all select id, 'history', history from decisions")
def _(fx):
    one = lambda c: fx.decisions.select("id", F.lit(c).alias("side"), F.col(c).alias("text"))
    return vt.union_all(one("task"), one("history"))


@query("q15_3_token_algebra", f"with s as (select id, {sql_tokset('task')} as t, {sql_tokset('history')} as h from decisions) select id, (len(t)+len(h)-{sql_common('t','h')})::int as n_union, {sql_common('t','h')}::int as n_inter, (len(t)-{sql_common('t','h')})::int as n_except from s")
def _(fx):
    d = fx.decisions.select("id", tx.token_set("task").alias("t"), tx.token_set("history").alias("h"))
    return d.select("id", F.size(F.array_union("t", "h")).alias("n_union"), F.size(F.array_intersect("t", "h")).alias("n_inter"), F.size(F.array_except("t", "h")).alias("n_except"))
