"""Queries over ranking, rules, guard and evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as ps, text as tx
from ..operators import evaluate as ev, profile as pf, rank as rk, rows as rw, rules as rl, split as sp
from .basic import r6
from .registry import TRAIN_SITES, query, sql_common, sql_jaccard, sql_tokset, sql_words, sql_wordset

BASE = ("id", "site_token", "task", "history", "cands", "op", "target_id", "value")

# per decision and candidate: open tokens, score, rank by (score desc, position)
_SCORED = f"""
with tk as materialized (select id, {sql_tokset('task')} as t, {sql_tokset('history')} as h from decisions),
rr as materialized (select id, t, list_filter(t, lambda x: not list_contains(h, x)) as r from tk),
ct as materialized (select id, cand_pos, candidate_id, tag, name, label, opts, text, {sql_tokset("text || ' ' || attrs")} as c from candidates),
sc as materialized (select ct.*, t, r, case when len(r) > 0 then {sql_common('r', 'c')}::double / len(r) else {sql_jaccard('t', 'c')} end as score from ct join rr using (id)),
rk as materialized (select *, row_number() over (partition by id order by score desc, cand_pos) as rn from sc),
pk as (select * from rk where rn = 1)
"""


def _picked(fx, *extra):
    return rk.pick_target(fx.decisions.select(*BASE, *extra))


@query("q9_1_pick_target", _SCORED + "select id, cand_pos as pick_pos, candidate_id as pick_id, round(score,6) as pick_score, cast(len(r) as int) as n_open from pk")
def _(fx):
    return _picked(fx).select("id", "pick_pos", "pick_id", r6("pick_score").alias("pick_score"), "n_open")


def _long_scores(fx):
    """Long candidate frame with the heuristic score."""
    d = rk.with_scores(rk.with_token_sets(fx.decisions.select(*BASE)))
    z = d.select("id", "op", "target_id", F.posexplode(F.arrays_zip("cands", "scores")).alias("cand_pos", "z"))
    return z.select("id", "op", "cand_pos", F.col("z.cands.candidate_id").alias("candidate_id"), F.col("z.cands.tag").alias("tag"),
                    F.round("z.scores", 9).alias("score"), (F.col("z.cands.candidate_id") == F.col("target_id")).cast("int").alias("is_target"))


_NORM = """select id, cand_pos, round((rnk-1)::double/greatest(n-1,1),6) as score_rank, round((score-m)/case when coalesce(sd,1.0)<1e-9 then 1.0 else coalesce(sd,1.0) end,6) as score_z,
 round(score/case when mx=0 then 1 else mx end,6) as score_fmax from (select id, cand_pos, score, rank() over (partition by id order by score desc) as rnk, count(*) over w as n, avg(score) over w as m,
 stddev_samp(score) over w as sd, max(score) over w as mx from (select id, cand_pos, round(score,9) as score from sc) window w as (partition by id))"""


@query("q7_1_group_norm", _SCORED + _NORM)
def _(fx):
    g = rk.group_norm(_long_scores(fx), ["score"])
    z = F.when(F.abs(F.col("score_z")) < 5e-7, 0.0).otherwise(F.col("score_z"))
    return g.select("id", "cand_pos", r6("score_rank").alias("score_rank"), r6(z).alias("score_z"), r6("score_fmax").alias("score_fmax"))


@query("q7_2_tag_count", """select c.candidate_id, count(*) over (partition by c.id, tag) as tag_count, cast(count(*) over (partition by c.id, tag) = 1 as int) as tag_unique
from candidates c join decisions d on d.id = c.id""")
def _(fx):
    c = rw.explode_candidates(fx.decisions, with_label=False)
    return rk.with_tag_count(c).select("candidate_id", "tag_count", "tag_unique")


_TRANK = """tr as (select d.id, cast(coalesce(max(rn) filter (where candidate_id = d.target_id), count(*)+1) as int) as target_rank from rk join
 (select id, case when id % 19 = 0 then 'gone' else target_id end as target_id from decisions) d on d.id = rk.id group by d.id)"""


def _gone(d):
    """Some decisions lose their target, so that the missing-target rule is met."""
    return d.withColumn("target_id", F.when(F.col("id") % 19 == 0, "gone").otherwise(F.col("target_id")))


def _ranked(fx):
    return rk.with_target_rank(rk.with_scores(rk.with_token_sets(_gone(fx.decisions.select(*BASE)))))


@query("q7_3_target_rank", _SCORED + "," + _TRANK + " select id, target_rank from tr")
def _(fx):
    return _ranked(fx).select("id", "target_rank")


@query("q7_3_target_rank_long", _SCORED + "," + _TRANK + " select id, target_rank from tr")
def _(fx):
    cand = _long_scores(fx)
    return rk.target_rank(cand.withColumn("is_target", F.when(F.col("id") % 19 == 0, 0).otherwise(F.col("is_target"))), "score")


_TVO = """tv as (select sc.id, max(score) filter (where candidate_id = target_id) as target, avg(score) filter (where candidate_id <> target_id) as others_mean,
 max(score) filter (where candidate_id <> target_id) as others_max from (select id, candidate_id, round(score,9) as score from sc) sc join decisions d on d.id=sc.id group by sc.id)"""


@query("q7_4_target_vs_others", _SCORED + "," + _TVO + " select id, round(target,6) as target, round(others_mean,6) as others_mean, round(others_max,6) as others_max from tv")
def _(fx):
    t = rk.target_vs_others(_long_scores(fx), "score")
    return t.select("id", *[r6(c).alias(c) for c in ("target", "others_mean", "others_max")])


@query("q7_4_win_rates", _SCORED + "," + _TVO + """ select count(*) as n, round(avg((target > round(others_mean,9))::int),6) as gt_mean, round(avg((target > others_max)::int),6) as gt_max,
 round(avg((target >= others_max)::int),6) as ge_max from tv where target is not null and others_mean is not null""")
def _(fx):
    t = rk.target_vs_others(_long_scores(fx), "score").withColumn("others_mean", F.round("others_mean", 9))
    return rk.win_rates(t).select("n", *[r6(c).alias(c) for c in ("gt_mean", "gt_max", "ge_max")])


@query("q7_5_target_position", "select target_pos as cand_pos, count(*) as n from decisions group by 1")
def _(fx):
    return rk.target_positions(rw.explode_candidates(fx.decisions))


@query("q9_2_top1", _SCORED + "select id, candidate_id, cand_pos, round(score,6) as score from pk")
def _(fx):
    return rk.top1(_long_scores(fx), "score").withColumn("score", r6("score"))


@query("q9_3_topk_accuracy", _SCORED + "," + _TRANK + " select round(avg((target_rank<=1)::int),6) as top1, round(avg((target_rank<=3)::int),6) as top3, round(avg((target_rank<=5)::int),6) as top5 from tr")
def _(fx):
    return rk.topk_accuracy(_ranked(fx)).select(*[r6(c).alias(c) for c in ("top1", "top3", "top5")])


@query("q12_15_ndcg", _SCORED + "," + _TRANK + " select " + ", ".join(
    f"round(avg(case when target_rank<={k} then 1/log2(1+target_rank) else 0.0 end),6) as ndcg{k}" for k in (1, 3, 5)) + " from tr")
def _(fx):
    return rk.ndcg(_ranked(fx)).select(*[r6(f"ndcg{k}").alias(f"ndcg{k}") for k in (1, 3, 5)])


@query("q9_4_baselines", """select round(avg((target_pos = 0)::int),6) as first, round(avg((rnd = target_id)::int),6) as random, round(avg(1.0::double/n_cands),6) as expected from decisions d join
 (select id, arg_min(candidate_id, md5('0|' || candidate_id)) as rnd from candidates group by id) r on r.id=d.id""")
def _(fx):
    b = rk.baselines(fx.decisions.select("id", "cands", "target_id"))
    return b.select(*[r6(c).alias(c) for c in ("first", "random", "expected")])


# ---------------------------------------------------------------- rules

# candidate match score for the fixture's three filled fields
_MATCH = f"""
with f as (select c.id, cand_pos, candidate_id, tag, text, label, name, opts, lower(d.task) as tl, {sql_wordset('d.task')} as tw, d.task, {sql_words("concat_ws(' ', text, label, '', '', name)")} as w
 from candidates c join decisions d on d.id = c.id),
m as (select *, len(list_filter(w, lambda x: length(x) > 2 and contains(tl, x))) + len(list_intersect(list_distinct(w), tw))::double / len(list_distinct(w)) as ms from f)
"""

_OPTS = """, ox as (select id, cand_pos, ord, o, case when contains(tl, lower(o)) then 1 else 0 end as hit, len(list_intersect(list_distinct(ow), tw))::double / greatest(len(list_distinct(ow)),1) as os, len(list_distinct(ow)) as n
 from (select id, cand_pos, tl, tw, o, ord, """ + sql_words("o") + """ as ow from (select id, cand_pos, tl, tw, unnest(string_split(opts,' / ')) as o, generate_subscripts(string_split(opts,' / '),1) as ord from m where opts <> ''))),
og as (select id, cand_pos, sum(case when hit=1 then 2.0 else os end) as osum, arg_min(o, ord) filter (where hit=1) as exact,
 arg_max(o, (os, -ord)) as near, max(os) as near_s, arg_max(n, (os, -ord)) as near_n from ox group by id, cand_pos),
tq as (select id, regexp_extract(task, '["'']([^"'']+)["'']', 1) as quoted from decisions),
sv as (select og.id, og.cand_pos, coalesce(exact, case when near_s > 0 and near_s >= case when near_n<=1 then 0.3 when near_n>=3 then 0.6 else 0.5 end then near end, nullif(trim(quoted),''), '') as sel_value from og join tq on tq.id=og.id)
"""


@query("q6_8_match_score", _MATCH + "select id, cand_pos, round(ms,6) as score from m")
def _(fx):
    d = rl.with_fields(fx.decisions.select("id", "task", "cands"))
    s = F.transform("cf", lambda f: rl.match_score(f, F.col("tl"), F.col("tw")))
    return d.select("id", F.posexplode(s).alias("cand_pos", "score")).withColumn("score", r6("score"))


@query("q6_9_relevance_score", _MATCH + _OPTS + """select m.id, m.cand_pos, round(ms + case when tag='select' then 2.0 else -1.0 end + coalesce(osum,0),6) as as_select,
 round(ms + case when tag in ('input','textarea') then 2.0 else -1.0 end,6) as as_type, round(ms + case when tag in ('button','a') then 1.0 else 0.0 end,6) as as_click
 from m left join og on og.id=m.id and og.cand_pos=m.cand_pos""")
def _(fx):
    d = rl.with_fields(fx.decisions.select("id", "task", "cands"))
    z = lambda op: F.transform("cf", lambda f: rl.relevance_score(f, F.col("tl"), F.col("tw"), F.lit(op)))
    d = d.select("id", F.posexplode(F.arrays_zip(*[z(o).alias(f"as_{o.lower()}") for o in ("SELECT", "TYPE", "CLICK")])).alias("cand_pos", "z"))
    return d.select("id", "cand_pos", *[r6(f"z.as_{o}").alias(f"as_{o}") for o in ("select", "type", "click")])


@query("q9_5_best_in_pool", _MATCH + """select id, candidate_id as best_id, tag as best_tag from (select *, row_number() over (partition by id order by (tag in ('button','a')) desc, round(ms,9) desc, candidate_id desc) as rn from m) where rn=1""")
def _(fx):
    d = rl.with_fields(fx.decisions.select("id", "task", "cands"))
    s = lambda f: rl.match_score(f, F.col("tl"), F.col("tw"))
    b = F.coalesce(rl.best_candidate(F.col("cf"), s, ("button", "a")), rl.best_candidate(F.col("cf"), s))
    return d.select("id", b.alias("b")).select("id", F.col("b.candidate_id").alias("best_id"), F.col("b.tag").alias("best_tag"))


@query("q9_6_top_values", "select label, count(*) as n from (select " + r"regexp_extract(task, 'Set the (\S+ \S+)', 1) as label from decisions) group by label order by n desc, label limit 5")
def _(fx):
    d = fx.decisions.select(F.regexp_extract("task", r"Set the (\S+ \S+)", 1).alias("label"))
    return pf.top_values(d, "label", 5)


@query("q10_1_op_from_tag", _SCORED + """select tag, case when tag in ('input','textarea') then 'TYPE' when tag='select' then 'SELECT' else 'CLICK' end as op, count(*) as n from pk group by 1,2""")
def _(fx):
    p = _picked(fx).select(F.col("pick.tag").alias("tag"))
    return p.groupBy("tag", rl.op_from_tag(F.col("tag"), check=True).alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("q10_2_op_from_task", r"""select doc_id, case when regexp_matches(lower(text), '\btype\b|\benter\b|\binput\b|fill(?:\s+in)?\b|write\b') then 'TYPE'
 when regexp_matches(lower(text), '\bselect\b|\bchoose\b|\bpick\b|\bset\b') then 'SELECT' else 'CLICK' end as op from
 (select doc_id, concat(text, case when doc_id % 3 = 0 then ' Enter the name' when doc_id % 3 = 1 then ' then Choose it' else ' open' end) as text from documents)""", needs=None)
def _(fx):
    tail = F.when(F.col("doc_id") % 3 == 0, " Enter the name").when(F.col("doc_id") % 3 == 1, " then Choose it").otherwise(" open")
    return fx.table("documents").select("doc_id", rl.op_from_task(F.concat("text", tail)).alias("op"))


def _target(fx, *extra):
    return fx.decisions.select("id", "task", "op", "value", rw.candidate_of("target_id").alias("c"), *extra)


@query("q10_3_value_after_label", r"""
with l as (select d.id, d.task, unnest([c.text, c.name, replace(c.name,'_',' '), c.label]) as lab, generate_subscripts([1,2,3,4],1) as ord from decisions d join candidates c on c.id=d.id and c.candidate_id=d.target_id where d.op='TYPE'),
u as (select *, row_number() over (partition by id, lower(lab) order by ord) as dup from l where lab <> ''),
v as (select id, ord, length(lab) as n, trim(trim(regexp_replace(trim(regexp_extract(task, '(?i)\b' || lab || '\b\s*[:]?\s*([^,\.\n]+)', 1)), '(?i)\s+(and|with|for|to|then)\b.*$', '')), ',.;') as v from u where dup = 1)
select d.id, coalesce(x.v,'') as value from decisions d left join (select id, v, row_number() over (partition by id order by n desc, ord) as rn from v where v <> '') x on x.id=d.id and x.rn=1 where d.op='TYPE'""")
def _(fx):
    return _target(fx).filter("op = 'TYPE'").select("id", rl.value_after_label(F.col("task"), F.col("c")).alias("value"))


@query("q10_4_longest_option", """
with o as (select d.id, trim(o) as o, ord, contains(lower(d.task), lower(trim(o))) as hit from (select id, unnest(string_split(opts,'/')) as o, generate_subscripts(string_split(opts,'/'),1) as ord, candidate_id from candidates where opts<>'') c join decisions d on d.id=c.id and d.target_id=c.candidate_id)
select d.id, coalesce(x.o,'') as value from decisions d left join (select *, row_number() over (partition by id order by length(o) desc, ord) as rn from o where hit) x on x.id=d.id and rn=1 where d.op='SELECT'""")
def _(fx):
    return _target(fx).filter("op = 'SELECT'").select("id", rl.longest_option_in_task(F.col("task"), ps.options(F.col("c.attrs"), "/")).alias("value"))


@query("q10_5_extract_value", _MATCH + _OPTS + r""", tv as (select m.id, m.cand_pos, m.tag, sel_value, quoted,
  trim(trim(regexp_extract(task, '(?i)' || label || '\s*([^,.;\n]+)', 1)), '"''') as by_label, trim(trim(regexp_extract(task, '(?i)' || name || '\s*([^,.;\n]+)', 1)), '"''') as by_name
  from m join tq on tq.id=m.id left join sv on sv.id=m.id and sv.cand_pos=m.cand_pos)
select id, cand_pos, coalesce(sel_value, trim(quoted)) as as_select, coalesce(nullif(trim(quoted),''), nullif(by_label,''), by_name) as as_type, '' as as_click from tv""")
def _(fx):
    d = rl.with_fields(fx.decisions.select("id", "task", "cands"))
    d = d.select("id", "task", "tw", F.posexplode("cf").alias("cand_pos", "f"))
    return d.select("id", "cand_pos", *[rl.extract_value(F.col("task"), F.lit(o), F.col("f"), F.col("tw")).alias(f"as_{o.lower()}") for o in ("SELECT", "TYPE", "CLICK")])


@query("q10_6_value_by_regex", r"""
with t as (select id, op, case when id % 4 = 0 then replace(task, '"', '') when id % 4 = 1 then concat('Mail bob', id, '@ex.org about ', replace(task,'"','')) when id % 4 = 2 then concat('go on March ', id % 28 + 1, ' to the ', lower(replace(task,'"',''))) else task end as t from decisions),
e as (select id, op, regexp_extract(t, '["''“”‘’]([^"''“”‘’]{1,80})["''“”‘’]', 1) as q, regexp_extract(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+') as m,
 regexp_extract(t, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s*\d+\b') as d, regexp_extract(t, '\b\d+\b') as n, regexp_extract(t, '\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b') as c from t)
select id, case op when 'CLICK' then '' when 'TYPE' then coalesce(nullif(q,''),nullif(m,''),nullif(d,''),nullif(n,''),c) else coalesce(nullif(q,''),nullif(d,''),c) end as value from e""")
def _(fx):
    bare = F.replace(F.col("task"), F.lit('"'), F.lit(""))
    k = F.col("id") % 4
    t = (F.when(k == 0, bare).when(k == 1, F.concat(F.lit("Mail bob"), "id", F.lit("@ex.org about "), bare))
         .when(k == 2, F.concat(F.lit("go on March "), (F.col("id") % 28 + 1).cast("string"), F.lit(" to the "), F.lower(bare))).otherwise(F.col("task")))
    return fx.decisions.select("id", rl.value_by_regex(t, F.col("op")).alias("value"))


_SNAP = """, sx as (select id, cand_pos, arg_min(o, ord) filter (where lower(o) = lower(v)) as eq, arg_max(o, (vs,-ord)) as near, max(vs) as vs, arg_max(o, (os,-ord)) as by_task from
 (select ox.*, v, len(list_intersect(list_distinct(""" + sql_words("o") + "), vw))::double / greatest(len(list_distinct(" + sql_words("o") + """)),1) as vs from ox join vals on vals.id = ox.id) group by id, cand_pos)"""


@query("q10_8_snap_option", _MATCH + _OPTS + ", vals as (select id, v, " + sql_wordset("v") + " as vw from (select id, case when id % 3 = 0 then upper(value) when id % 3 = 1 then 'red thing' else '' end as v from decisions))" + _SNAP + """
 select sx.id, cand_pos, coalesce(eq, case when len(vw) > 0 and vs >= 0.5 then near end, by_task) as snapped from sx join vals on vals.id = sx.id""")
def _(fx):
    k = F.col("id") % 3
    v = F.when(k == 0, F.upper("value")).when(k == 1, "red thing").otherwise("")
    d = rl.with_fields(fx.decisions.select("id", "task", "cands", v.alias("v")))
    d = d.select("id", "tw", "v", F.posexplode("cf").alias("cand_pos", "f")).filter(F.size("f.opts") > 0)
    return d.select("id", "cand_pos", rl.snap_option(F.col("f.opts"), F.col("tw"), F.col("v")).alias("snapped"))


# task verbs of the fixture ("Set the …") always give SELECT
_FALLBACK = _MATCH + _OPTS + """, fb as (select id, cand_pos, candidate_id, tag from (select m.*, row_number() over (partition by m.id order by (tag='select') desc, round(ms + case when tag='select' then 2.0 else -1.0 end + coalesce(osum,0),9) desc, candidate_id desc) as rn
 from m left join og on og.id=m.id and og.cand_pos=m.cand_pos) where rn=1),
fv as (select fb.*, coalesce(sel_value, trim(quoted)) as value from fb join tq on tq.id=fb.id left join sv on sv.id=fb.id and sv.cand_pos=fb.cand_pos)"""


@query("q10_9_fallback_rules", _FALLBACK + "select id, 'SELECT' as fb_op, candidate_id as fb_target_id, value as fb_value from fv")
def _(fx):
    d = rl.fallback(rl.with_fields(fx.decisions.select("id", "task", "cands")))
    return d.select("id", "fb_op", "fb_target_id", "fb_value")


def _shaky(fx, extra=()):
    """Predictions with every kind of fault the guard repairs."""
    k = F.col("id")
    return fx.decisions.select(
        "id", "task", "cands", *extra,
        F.when(k % 17 == 0, "hover").when(k % 4 == 0, "CLICK").when(k % 9 == 0, "type").otherwise(F.col("op")).alias("op"),
        F.when(k % 7 == 0, "gone").when(k % 5 == 0, F.concat(F.lit("c_"), "id", F.lit("_0"))).otherwise(F.col("target_id")).alias("target_id"),
        F.when(k % 8 == 0, "").when(k % 3 == 0, F.upper("value")).otherwise(F.col("value")).alias("value"))


_PRED = """, p0 as (select id, case when id%17=0 then 'HOVER' when id%4=0 then 'CLICK' when id%9=0 then 'TYPE' else op end as op, case when id%7=0 then 'gone' when id%5=0 then concat('c_',id,'_0') else target_id end as target_id,
 case when id%8=0 then '' when id%3=0 then upper(value) else value end as value from decisions),
p1 as (select p0.id, op = 'HOVER' as bad_op_to_click, p0.target_id = 'gone' as inv, case when p0.target_id='gone' then 'SELECT' when op='HOVER' then 'CLICK' else op end as op,
 case when p0.target_id='gone' then fv.candidate_id else p0.target_id end as target_id, case when p0.target_id='gone' then fv.value else p0.value end as value from p0 join fv on fv.id=p0.id)"""

_CLICKABLE = """, bb as (select id, candidate_id, tag from (select *, row_number() over (partition by id order by round(ms,9) desc, candidate_id desc) as rn from m where tag in ('button','a')) where rn=1)"""

_GUARD_TAIL = """, g1 as (select p.*, m.tag, m.cand_pos, case when p.op='CLICK' and m.tag='select' then coalesce(sv.sel_value,'') else '' end as ext, bb.candidate_id as bb_id from {src} p join m on m.id=p.id and m.candidate_id=p.target_id
  left join sv on sv.id=m.id and sv.cand_pos=m.cand_pos left join bb on bb.id=p.id),
g2 as (select *, ext <> '' as up, (op='CLICK' and tag='select' and ext='' and bb_id is not null) as sw from g1),
g3 as (select g2.* exclude (op, target_id, value), case when up then 'SELECT' else op end as op, case when sw then bb_id else target_id end as target_id, case when up then ext else value end as value from g2),
vals as (select id, value as v, """ + sql_wordset("value") + """ as vw from g3)""" + _SNAP + """,
g4 as (select g3.*, mm.opts, tq.quoted, case when g3.op='SELECT' then coalesce(sx.eq, case when len(vw)>0 and sx.vs>=0.5 then sx.near end, sx.by_task, '') end as snap
 from g3 join m mm on mm.id=g3.id and mm.candidate_id=g3.target_id join vals on vals.id=g3.id join tq on tq.id=g3.id left join sx on sx.id=mm.id and sx.cand_pos=mm.cand_pos),
g5 as (select *, case when snap='' then coalesce(nullif(value,''), trim(quoted)) end as raw from g4),
g6 as (select *, coalesce(raw <> '', false) as select_value_kept_raw, coalesce(snap <> '' and snap <> value, false) as select_value_repaired, coalesce(raw, snap, value) as v2 from g5)
"""

_GUARD_OUT = """ bad_op_to_click, inv as invalid_target_repaired, {strict} up as click_select_upgraded, sw as click_select_target_switched,
 select_value_kept_raw, select_value_repaired, (op='CLICK' and v2 <> '') as click_value_cleared """

_LOOSE = "false as type_target_switched, false as type_downgraded_click, false as select_target_switched, false as select_downgraded_click,"
_GUARD = _FALLBACK + _PRED + _CLICKABLE + _GUARD_TAIL.replace("{src}", "p1")
_GUARD_SEL = "select id, op, target_id, case when op='CLICK' then '' else v2 end as value," + _GUARD_OUT


@query("q10_7_enforce", _GUARD + _GUARD_SEL.format(strict=_LOOSE) + " from g6")
def _(fx):
    return rl.enforce(_shaky(fx)).drop("task", "cands")


# strict: early variant of the select value (one threshold, ISO date anywhere), plus tag switching
_STRICT = _GUARD_TAIL.replace("{src}", "s2")
_SV_EARLY = _OPTS.replace("case when near_n<=1 then 0.3 when near_n>=3 then 0.6 else 0.5 end", "0.5").replace(
    "nullif(trim(quoted),''), '')", "nullif(trim(quoted),''), regexp_extract(t2.task, '\\d{4}-\\d{2}-\\d{2}'))").replace(
    "join tq on tq.id=og.id)", "join tq on tq.id=og.id join decisions t2 on t2.id=og.id)")
_FB_EARLY = _FALLBACK.replace(_OPTS, _SV_EARLY).replace("coalesce(sel_value, trim(quoted)) as value", "coalesce(sel_value, nullif(trim(quoted),''), regexp_extract(t3.task, '\\d{4}-\\d{2}-\\d{2}')) as value").replace(
    "join tq on tq.id=fb.id", "join tq on tq.id=fb.id join decisions t3 on t3.id=fb.id")
_TYPE_VAL = r"""coalesce(nullif(trim(quoted),''), nullif(trim(trim(regexp_extract(b.task, '(?i)' || b.label || '\s*([^,.;\n]+)', 1)), '"'''),''),
  nullif(trim(trim(regexp_extract(b.task, '(?i)' || b.name || '\s*([^,.;\n]+)', 1)), '"'''),''), regexp_extract(b.task, '\d{4}-\d{2}-\d{2}'))"""
_SWITCH = f""", bi as (select b.id, b.candidate_id, b.cand_pos, {_TYPE_VAL} as tval from (select *, row_number() over (partition by id order by round(ms,9) desc, candidate_id desc) as rn from m where tag in ('input','textarea')) b join tq on tq.id=b.id where rn=1),
bs as (select b.id, b.candidate_id, b.cand_pos, sv.sel_value from (select *, row_number() over (partition by id order by round(ms,9) desc, candidate_id desc) as rn from m where tag = 'select') b join sv on sv.id=b.id and sv.cand_pos=b.cand_pos where rn=1),
s1 as (select p.id, bad_op_to_click, inv, p.op as op0, (p.op='TYPE' and m.tag not in ('input','textarea')) as off, bi.candidate_id as bi_id, bi.tval, p.value, p.target_id, m.tag from p1 p join m on m.id=p.id and m.candidate_id=p.target_id left join bi on bi.id=p.id),
s1b as (select id, bad_op_to_click, inv, off and bi_id is not null as tsw, off and bi_id is null as tdown, case when off and bi_id is null then 'CLICK' else op0 end as op, case when off and bi_id is not null then bi_id else target_id end as target_id,
  case when off and bi_id is not null then coalesce(nullif(tval,''), value) when off then '' else value end as value from s1),
s2a as (select s.*, (s.op='SELECT' and m.tag <> 'select') as off, bs.candidate_id as bs_id, bs.sel_value from s1b s join m on m.id=s.id and m.candidate_id=s.target_id left join bs on bs.id=s.id),
s2 as (select id, bad_op_to_click, inv, tsw, tdown, off and bs_id is not null as ssw, off and bs_id is null as sdown, case when off and bs_id is null then 'CLICK' else op end as op, case when off and bs_id is not null then bs_id else target_id end as target_id,
  case when off and bs_id is not null then coalesce(nullif(sel_value,''), value) when off then '' else value end as value from s2a)"""


@query("q10_7_enforce_strict", (_FB_EARLY + _PRED + _CLICKABLE + _SWITCH + _STRICT) + _GUARD_SEL.format(
    strict="tsw as type_target_switched, tdown as type_downgraded_click, ssw as select_target_switched, sdown as select_downgraded_click,") + " from g6")
def _(fx):
    return rl.enforce(_shaky(fx), strict=True).drop("task", "cands")


@query("q10_10_repair_report", _GUARD + ", o as (" + _GUARD_SEL.format(strict=_LOOSE) + " from g6) select repair, n, round(n::double / total, 6) as share from (" + " union all ".join(
    f"select '{f}' as repair, count(*) filter (where {f}) as n, count(*) as total from o" for f in rl.AUDIT) + ")")
def _(fx):
    return rl.repair_report(rl.enforce(_shaky(fx))).withColumn("share", r6("share"))


@query("q10_11_merge_value", _MATCH + _OPTS + r"""select d.id, case when d.op='CLICK' then '' when pv <> '' then pv else coalesce(case when d.op='SELECT' then sel_value end, nullif(trim(quoted),''),
   case when d.op='TYPE' then coalesce(nullif(trim(trim(regexp_extract(d.task, '(?i)' || m.label || '\s*([^,.;\n]+)', 1)), '"'''),''), trim(trim(regexp_extract(d.task, '(?i)' || m.name || '\s*([^,.;\n]+)', 1)), '"''')) else '' end) end as value
 from (select *, case when id % 2 = 0 then '' else value end as pv from decisions) d join m on m.id=d.id and m.candidate_id=d.target_id join tq on tq.id=d.id left join sv on sv.id=m.id and sv.cand_pos=m.cand_pos""")
def _(fx):
    d = rl.with_fields(fx.decisions.select("id", "task", "cands", "op", "target_id", "value"))
    d = d.withColumn("f", rw.candidate_of("target_id", "cf")).withColumn("v", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("value")))
    rule = rl.extract_value(F.col("task"), F.col("op"), F.col("f"), F.col("tw"))
    return d.select("id", rl.merge_value(F.col("op"), F.col("v"), rule).alias("value"))


# ---------------------------------------------------------------- evaluation

# heuristic answer per decision
_ANSWER = _SCORED + r""", pl as materialized (select id, task, unnest([text, name, replace(name,'_',' '), label]) as lab, generate_subscripts([1,2,3,4],1) as ord from (select pk.*, task from pk join decisions d on d.id=pk.id) where tag in ('input','textarea')),
pu as materialized (select *, row_number() over (partition by id, lower(lab) order by ord) as dup from pl where lab <> ''),
pv as materialized (select id, ord, length(lab) as n, trim(trim(regexp_replace(trim(regexp_extract(task, '(?i)\b' || lab || '\b\s*[:]?\s*([^,\.\n]+)', 1)), '(?i)\s+(and|with|for|to|then)\b.*$', '')), ',.;') as v from pu where dup=1),
pt as materialized (select id, v from (select *, row_number() over (partition by id order by n desc, ord) as rn from pv where v <> '') where rn=1),
po as materialized (select id, o, row_number() over (partition by id order by length(o) desc, ord) as rn from (select x.id, trim(o) as o, ord, task from (select id, unnest(string_split(opts,'/')) as o, generate_subscripts(string_split(opts,'/'),1) as ord from pk where tag='select') x join decisions d on d.id=x.id) where contains(lower(task), lower(o))),
an as materialized (select pk.id, pk.candidate_id as pred_target_id, len(pk.r) as n_open, case when tag in ('input','textarea') then 'TYPE' when tag='select' then 'SELECT' else 'CLICK' end as pred_op,
 case when tag='select' then coalesce(po.o,'') when tag in ('input','textarea') then coalesce(pt.v,'') else '' end as pred_value from pk left join pt on pt.id=pk.id left join po on po.id=pk.id and po.rn=1),
hits as materialized (select d.id, d.op, d.site_token, case when contains(cleaned_html,'workflow-context') or contains(cleaned_html,'completed-fields') then 'workflow' else 'real_web' end as html_type,
 d.site_token in """ + TRAIN_SITES + r""" as site_seen, an.n_open, pred_op, pred_value, (pred_op=d.op)::int as o, (pred_target_id=d.target_id)::int as t, (pred_value=d.value)::int as v, (pred_op=d.op and pred_target_id=d.target_id and pred_value=d.value)::int as a
 from decisions d join an on an.id=d.id)
"""
_M = "count(*) as n, round(avg(o),6) as op_acc, round(avg(t),6) as target_id_acc, round(avg(v),6) as value_acc, round(avg(a),6) as exact_match"
_MCOLS = ("op_acc", "target_id_acc", "value_acc", "exact_match")


def _answers(fx, *extra):
    return rl.apply_rules(_picked(fx, *extra))


def _hits(fx, *extra):
    return ev.with_hits(_answers(fx, *extra))


def _m(df, cols=_MCOLS):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("q0_flagship", _ANSWER + f"select 'overall' as slice, {_M} from hits union all select concat('site_seen=', site_seen), {_M} from hits group by site_seen union all select concat('html_type=', html_type), {_M} from hits group by html_type")
def _(fx):
    from ..functions.parse import html_type
    a = _answers(fx, html_type("cleaned_html").alias("html_type"))
    a = a.select("id", "site_token", "html_type", "op", "target_id", "value", "pred_op", "pred_target_id", "pred_value")
    seen = rw.with_site_seen(a, sp.group_split(fx.decisions.select("site_token")).filter("not is_valid"))
    return _m(ev.evaluate_slices(ev.with_hits(seen)))


@query("q12_1_evaluate", _ANSWER + f"select {_M} from hits")
def _(fx):
    return _m(ev.evaluate(_hits(fx)))


@query("q12_2_evaluate_slices", _ANSWER + f"select 'overall' as slice, {_M} from hits union all select concat('site_seen=', site_seen), {_M} from hits group by site_seen union all select concat('html_type=', html_type), {_M} from hits group by html_type")
def _(fx):
    # predictions come from another table here, as when a submission is scored
    a = _answers(fx).select("id", F.col("pred_op").alias("op"), F.col("pred_target_id").alias("target_id"), F.col("pred_value").alias("value"))
    truth = rw.with_html_type(fx.decisions.select("id", "site_token", "cleaned_html", "op", "target_id", "value")).drop("cleaned_html")
    seen = rw.with_site_seen(truth, sp.group_split(fx.decisions.select("site_token")).filter("not is_valid"))
    return _m(ev.evaluate_slices(ev.with_hits(ev.join_predictions(a, seen))))


@query("q12_3_confusion", _ANSWER + """select l as true_op, count(*) filter (where pred_op='CLICK') as pred_CLICK, count(*) filter (where pred_op='TYPE') as pred_TYPE, count(*) filter (where pred_op='SELECT') as pred_SELECT
 from (select unnest(['CLICK','TYPE','SELECT']) as l) left join hits on op=l group by l""")
def _(fx):
    return ev.confusion(_answers(fx).select("op", "pred_op"))


@query("q12_4_conditional_accuracy", _ANSWER + "select 'all' as true_op, count(*) as n, round(avg(o),6) as op_acc, round(avg(v),6) as value_acc from hits where t=1 union all select op, count(*), round(avg(o),6), round(avg(v),6) from hits where t=1 group by op")
def _(fx):
    return _m(ev.conditional_accuracy(_hits(fx)))


@query("q12_5_fold_summary", """with h as (select v.fold, (v.op=d.op)::int as o, (v.target_id=d.target_id)::int as t, (v.value=d.value)::int as v, (v.op=d.op and v.target_id=d.target_id and v.value=d.value)::int as a from votes v join decisions d on d.id=v.id),
p as (select cast(fold as varchar) as fold, count(*)::double as n, avg(o) as op_acc, avg(t) as target_id_acc, avg(v) as value_acc, avg(a) as exact_match from h group by fold)
select fold, n, round(op_acc,6) as op_acc, round(target_id_acc,6) as target_id_acc, round(value_acc,6) as value_acc, round(exact_match,6) as exact_match from p union all select 'mean', avg(n), round(avg(op_acc),6), round(avg(target_id_acc),6), round(avg(value_acc),6), round(avg(exact_match),6) from p""", needs="decisions votes")
def _(fx):
    p = fx.votes.select("id", "fold", *[F.col(c).alias(f"pred_{c}") for c in ("op", "target_id", "value")])
    hits = ev.with_hits(fx.decisions.select("id", "op", "target_id", "value").join(p, "id"))
    return _m(ev.fold_summary(hits))


@query("q12_6_site_overlap", """with p as (select site_token as s, row_number() over (order by md5(concat('0|', id)), id::varchar) <= floor(count(*) over () * 0.2) as v from decisions), a as (select distinct s from p where not v), b as (select distinct s from p where v)
select (select count(*) from a where s not in (select s from b)) as only_train, (select count(*) from b where s not in (select s from a)) as only_test, (select count(*) from a where s in (select s from b)) as both""")
def _(fx):
    d = fx.decisions.select("id", "site_token")
    d = sp.row_split(d)
    return pf.site_overlap(d.filter("not is_valid"), d.filter("is_valid"))


@query("q12_7_op_by_steps", r"""with s as (select op, len(regexp_extract_all(history,'Step \d+:')) as k from decisions), b as (select case when k=0 then '0' when k<=3 then '1-3' else '4+' end as bucket, op from s)
select bucket, op, count(*) as n, sum(count(*)) over (partition by bucket)::bigint as rows, round(count(*)::double / sum(count(*)) over (partition by bucket),6) as share from b group by bucket, op""")
def _(fx):
    return ev.op_by_steps(fx.decisions.select("op", "history"), ps.n_steps("history")).withColumn("share", r6("share"))


@query("q12_8_check_submission", """select count(*) as rows, count(*) filter (where coalesce(t,'')='') as empty_targets, count(*) filter (where o is null or t is null or v is null) as nulls, count(*) filter (where coalesce(o,'') not in ('CLICK','TYPE','SELECT')) as bad_ops,
 count(*) filter (where o='CLICK' and coalesce(v,'')<>'') as click_with_value from (select case when id%17=0 then 'hover' when id%4=0 then 'CLICK' else op end as o, case when id%13=0 then null when id%7=0 then '' else target_id end as t, value as v from decisions)""")
def _(fx):
    k = F.col("id")
    return ev.check_submission(fx.decisions.select(
        F.when(k % 17 == 0, "hover").when(k % 4 == 0, "CLICK").otherwise(F.col("op")).alias("op"),
        F.when(k % 13 == 0, None).when(k % 7 == 0, "").otherwise(F.col("target_id")).alias("target_id"), "value"))


@query("q12_9_target_present", "select count(*) as rows, count(*) filter (where id % 9 <> 0) as present, round(avg((id % 9 <> 0)::int),6) as ratio from decisions")
def _(fx):
    d = fx.decisions.select("id", "cands", F.when(F.col("id") % 9 == 0, "gone").otherwise(F.col("target_id")).alias("target_id"))
    return ev.target_present(rw.with_target_present(d)).withColumn("ratio", r6("ratio"))


@query("q12_10_prompt_length", """select round(avg(l*0.25::double),6) as mean_tokens, max(l)*0.25::double as max_tokens, count(*) filter (where l*0.25 > 60) as over_limit, round(avg((l*0.25 > 60)::int),6) as over_share from (select length(task)+length(history) as l from decisions)""")
def _(fx):
    d = fx.decisions.select(F.concat("task", "history").alias("prompt"))
    p = ev.prompt_length(d, limit=60)
    return p.select(r6("mean_tokens").alias("mean_tokens"), F.col("max_tokens").cast("double").alias("max_tokens"), "over_limit", r6("over_share").alias("over_share"))


@query("q12_11_default_rate", "select count(*) as rows, count(*) filter (where target_id = concat('c_', id, '_0')) as defaults, round(avg((target_id = concat('c_', id, '_0'))::int),6) as rate from votes where fold = 2", needs="decisions votes")
def _(fx):
    return ev.default_rate(fx.votes.filter("fold = 2"), fx.decisions.select("id", "cands")).withColumn("rate", r6("rate"))


@query("q8_12_binned_accuracy", _ANSWER + """, b as (select unnest(['0-0','1-3','4-6','7-9','10-14','15+']) as bin, unnest([0,1,4,7,10,15]) as lo, unnest([0,3,6,9,14,9223372036854775807]) as hi)
select bin, count(t) as n, coalesce(round(avg(t),6),0) as accuracy from b left join hits on n_open between lo and hi group by bin""")
def _(fx):
    h = _hits(fx).select("n_open", "ok_target_id")
    return pf.binned_accuracy(h, "n_open", "ok_target_id").withColumn("accuracy", r6("accuracy"))
