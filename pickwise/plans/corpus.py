"""Queries over training records."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import parse as ps
from ..operators import corpus as cp, dom, evaluate as ev, rank as rk, retrieve as rt, rules as rl, rows as rw
from .basic import r6
from .pages import candidates, decision_stream
from .registry import once, query
from .retrieval import EXAMPLE_LINES, examples, sql_newest
from .scoring import BASE, _MATCH

COLS = (*BASE, "cleaned_html")

_LINE = """concat(lpad((cand_pos+1)::varchar, greatest(2, length((cand_pos+1)::varchar))::int, ' '), '. [', tag, '] "', substr(case when text<>'' then text else concat('[name:', substr(name,1,40), ']') end,1,60), '" | name=', substr(name,1,60), ' | label=', substr(label,1,60), case when opts='' then '' else concat(' | options=', substr(opts,1,60)) end)"""
_LEGACY = """concat(lpad((cand_pos+1)::varchar, greatest(2, length((cand_pos+1)::varchar))::int, ' '), '. [', tag, ']', case when text='' then '' else concat(' "', text, '"') end, ' | ', case when length(attrs)>120 then substr(attrs,1,120) || '...' else attrs end)"""


@query("q11_1_format_candidates", f"select d.id, string_agg({_LINE}, chr(10) order by cand_pos) as listed, string_agg({_LEGACY}, chr(10) order by cand_pos) as legacy from candidates c join decisions d on d.id=c.id group by d.id")
def _(fx):
    return fx.decisions.select("id", cp.format_candidates(F.col("cands")).alias("listed"), cp.format_candidates(F.col("cands"), "legacy").alias("legacy"))


@query("q11_1_format_compact", f"select d.id, string_agg({_LINE}, chr(10) order by cand_pos) as listed from candidates c join decisions d on d.id=c.id group by d.id")
def _(fx):
    return fx.decisions.select("id", cp.format_candidates(F.col("cands"), "compact").alias("listed"))


@query("q11_1_debug_listing", """select d.id, concat('Task : ', task, chr(10), 'Op   : ', op, chr(10), 'Value: ', value, chr(10), 'Target: ', target_id, chr(10), repeat('-',60), chr(10),
 string_agg(concat(case when candidate_id=target_id then '>>> ' else '    ' end, candidate_id, ' <', tag, '> text=''', substr(text,1,50), ''' attrs=''', substr(attrs,1,40), ''''), chr(10) order by cand_pos)) as sheet
 from candidates c join decisions d on d.id=c.id group by d.id, task, op, value, target_id""")
def _(fx):
    return fx.decisions.select("id", cp.debug_listing(F.col("task"), F.col("op"), F.col("value"), F.col("target_id"), F.col("cands")).alias("sheet"))


@query("q3_9_rerank", _MATCH + "select id, (row_number() over (partition by id order by round(ms,9) desc, cand_pos) - 1)::int as prompt_pos, candidate_id from m")
def _(fx):
    d = cp.rerank(fx.decisions.select("id", "task", "cands"))
    return d.select("id", F.posexplode("prompt_cands").alias("prompt_pos", "c")).select("id", "prompt_pos", "c.candidate_id")


_q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

_SHORT = r"""hp as (select id, generate_subscripts(string_split(history, ' | '), 1) as i, unnest(string_split(history, ' | ')) as s from decisions where history <> ''),
hq as (select id, i, regexp_extract(s, '\[([^\]]+)\]', 1) as tag, substr(trim(regexp_extract(s, '\] (.*?) ?-> ', 1)),1,30) as text, regexp_extract(s, '-> (\w+)', 1) as op, substr(trim(regexp_extract(s, '-> \w+: (.*)$', 1)),1,20) as value from hp),
sh as (select id, string_agg(concat('[',tag,']', case when text='' then '' else ' '||text end, '→', op, case when value<>'' and op<>'CLICK' then ':'||value else '' end), ' | ' order by i) as short from hq group by id),
ls as (select id, string_agg(""" + _LINE + """, chr(10) order by cand_pos) as listed, string_agg(""" + _LEGACY + """, chr(10) order by cand_pos) as legacy from candidates group by id),
wf as (select id, case when id % 3 = 0 then regexp_extract(cleaned_html, 'current step (\\d+) of (\\d+)', 1) end as cur, case when id % 3 = 0 then regexp_extract(cleaned_html, 'current step (\\d+) of (\\d+)', 2) end as tot,
 case when id % 3 = 0 then trim(regexp_extract(cleaned_html, 'Completed:\\s*([^\\n<]+)', 1)) end as done from decisions)"""


def _prompt_sql(n="d.n_cands", block=None):
    answer = _q(cp.ANSWER).replace("%s", f"' || {n} || '")
    more = f"{block} || chr(10) || chr(10) || " if block else ""
    return (f"{_q(cp.ROLE)} || chr(10) || chr(10) || {more}'[Candidate Elements] (Total: ' || {n} || ')' || chr(10) || listed || chr(10) || chr(10) || '[Task]' || chr(10) || d.task || chr(10) || chr(10) || '[History]' || chr(10) || coalesce(short,'None') "
            f"|| chr(10) || chr(10) || {_q(cp.GUIDE)} || chr(10) || chr(10) || {answer} || case when d.id % 3 = 0 then chr(10) || chr(10) || '[Workflow Status]' || chr(10) || 'Step ' || cur || ' of ' || tot || chr(10) || case when done<>'' then 'Completed Fields: ' || done || chr(10) else '' end else '' end")


@query("q11_4_build_prompt", f"with {_SHORT} select d.id, {_prompt_sql()} as prompt from decisions d join ls on ls.id=d.id join wf on wf.id=d.id left join sh on sh.id=d.id")
def _(fx):
    return cp.build_prompt(fx.decisions.select(*COLS)).select("id", "prompt")


@query("q11_4_build_prompt_early", f"""with {_SHORT} select d.id, {_q(cp.ROLE)} || chr(10) || chr(10) || '[Candidate Elements] — choose one number (1-' || d.n_cands || ')' || chr(10) || legacy || chr(10) || chr(10) || '[Task]' || chr(10) || d.task || chr(10) || chr(10) || '[History]' || chr(10) ||
 case when d.history='' then 'None' else d.history end || chr(10) || chr(10) || case when d.id % 3 = 0 then '[Workflow Status]' || chr(10) || 'Progress: step ' || cur || ' of ' || tot || chr(10) || case when done<>'' then 'Already completed (do not select): ' || done else '' end else '' end || chr(10) || chr(10) || """
       + _q(cp.ANSWER_ONLY).replace("%s", "' || d.n_cands || '") + " as prompt from decisions d join ls on ls.id=d.id join wf on wf.id=d.id")
def _(fx):
    return cp.build_prompt(fx.decisions.select(*COLS), variant="early").select("id", "prompt")


@query("q11_4_prompt_with_examples", sql_newest(3) + EXAMPLE_LINES + f""", {_SHORT}, pr as (select d.id, {_prompt_sql(block="concat('[Similar Past Examples]', chr(10), coalesce(xl.t, 'None'))")} as prompt
 from decisions d join ls on ls.id=d.id join wf on wf.id=d.id left join sh on sh.id=d.id left join xl on xl.id=d.id) select id, length(prompt)::int as chars, md5(prompt) as digest from pr""")
def _(fx):
    ex = examples(fx)
    blocks = rt.format_examples(ex, rt.retrieve(ex, ex, 3), ex)
    p = cp.build_prompt(fx.decisions.select(*COLS), examples=blocks)
    return p.select("id", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest"))


def _fill(template: str, *parts: str) -> str:
    """SQL text of a sentence with numbered places."""
    pieces = re.split(r"%(\d)\$s", template)
    return "concat(" + ", ".join(_q(p) if i % 2 == 0 else parts[int(p) - 1] for i, p in enumerate(pieces)) + ")"


def _said(sentences, *parts: str) -> str:
    return "case op when 'CLICK' then " + _fill(sentences["CLICK"], *parts) + " when 'TYPE' then " + _fill(sentences["TYPE"], *parts) + " else " + _fill(sentences["SELECT"], *parts) + " end"


_TGT = f"""t as (select d.*, c.tag, case when trim(c.text)<>'' then trim(c.text) else c.label end as lab, d.target_pos + 1 as choice,
 (select min(o.cand_pos)+1 from candidates o where o.id=d.id and o.tag=c.tag and o.cand_pos<>d.target_pos) as sim from decisions d join candidates c on c.id=d.id and c.candidate_id=d.target_id),
el as (select *, concat(tag, ' number ', choice, ' (', substr(lab,1,20), ')') as el, case when sim is null then '' else {_fill(cp.CONTRAST, "sim")} end as con, substr(trim(task),1,40) as goal from t)"""
_WHY = f"substr({_said(cp.REASON, 'goal', 'el', _q(''), 'con', 'substr(value,1,20)')}, 1, 200)"
_EARLY = _said(cp.REASON_EARLY, _q(""), "concat('Number ', choice, ', ', tag, ' ', substr(lab,1,40))", _q(""), _q(""), "substr(value,1,30)")


@query("q11_5_reasoning", f"with {_TGT} select id, {_WHY} as why, {_EARLY} as why_early from el")
def _(fx):
    c, pos = rw.candidate_of("target_id"), F.col("target_pos") + 1
    d = fx.decisions.select("id", "task", "op", "value", "cands", pos.alias("choice"), c.alias("c"))
    return d.select("id", cp.reasoning(F.col("task"), F.col("op"), F.col("choice"), F.col("c"), F.col("value"), F.col("cands")).alias("why"),
                    cp.reasoning_early(F.col("op"), F.col("choice"), F.col("c"), F.col("value")).alias("why_early"))


@query("q11_6_pairs_first", """with o as (select c.id, arg_min(candidate_id, cand_pos) as other from candidates c join decisions d on d.id=c.id where c.candidate_id<>d.target_id group by c.id),
x as (select d.*, o.other, case when d.value='' then 'null' else '"' || d.value || '"' end as v from decisions d left join o on o.id=d.id)
select id, concat('{"op":"',op,'","target_id":"',target_id,'","value":',v,'}') as chosen, case when other is not null then concat('{"op":"',op,'","target_id":"',other,'","value":',v,'}') when op<>'CLICK' then concat('{"op":"CLICK","target_id":"',target_id,'","value":null}')
 else concat('{"op":"TYPE","target_id":"',target_id,'","value":"wrong_value"}') end as rejected from x""")
def _(fx):
    return cp.pairs_first(fx.decisions.select("id", "cands", "op", "target_id", "value"))


_FN = "((lower(trim(o.text))<>'' and lower(trim(o.text))=lower(trim(t.text))) or (lower(o.label)<>'' and lower(o.label)=lower(t.label)))"


@query("q11_8_false_negative", f"select d.id, o.cand_pos, (o.candidate_id=d.target_id or {_FN}) as look_alike from decisions d join candidates t on t.id=d.id and t.candidate_id=d.target_id join candidates o on o.id=d.id")
def _(fx):
    d = rl.with_fields(fx.decisions.select("id", "task", "cands", "target_id")).withColumn("t", rw.candidate_of("target_id", "cf"))
    z = F.transform("cf", lambda f: cp.is_false_negative(f, F.col("t")))
    return d.select("id", F.posexplode(z).alias("cand_pos", "look_alike"))


# a page element of the fixture is the one input of a workflow page; it carries the target's name
_HARD = _MATCH + f""", oo as (select o.id, o.cand_pos, o.tag, o.ms, {_FN} as fn, (d.id % 3 = 0 and t.tag='input' and o.tag='input' and o.name=t.name) as near, o.tag = t.tag as same from m o join decisions d on d.id=o.id join m t on t.id=d.id and t.candidate_id=d.target_id where o.candidate_id<>d.target_id),
kk as (select *, count(*) filter (where not fn) over (partition by id) as kept from oo), pp as (select * from kk where kept = 0 or not fn),
ss as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by round(ms,9) desc, cand_pos) as rn from pp),
hh as (select id, cand_pos, round({{near}} + 1.5*(n-(rn-1))::double/n + case when same then 0.2 else 0 end, 9) as total from ss),
hn as (select id, cand_pos as neg_pos, total from (select *, row_number() over (partition by id order by total desc, cand_pos) as k from hh) where k=1)"""


@query("q11_7_hard_negative", _HARD.replace("{near}", "case when near then 1.5 else 0 end") + " select d.id, neg_pos, round(total,6) as neg_score from decisions d left join hn on hn.id=d.id")
def _(fx):
    h = cp.hard_negative(dom.with_places(fx.decisions.select(*COLS)))
    return h.select("id", "neg_pos", r6("neg_score").alias("neg_score"))


@query("q11_7_hard_negative_lexical", _HARD.replace("{near}", "0") + " select d.id, neg_pos, round(total,6) as neg_score from decisions d left join hn on hn.id=d.id")
def _(fx):
    h = cp.hard_negative(fx.decisions.select(*BASE))
    return h.select("id", "neg_pos", r6("neg_score").alias("neg_score"))


_AUG = """with cp as (select d.id, d.aug, c.candidate_id, c.tag, d.target_id, d.n_cands, row_number() over (partition by d.id, d.aug order by md5(concat('42|', d.id, '|', d.aug, '|', c.candidate_id)), c.cand_pos) - 1 as p
 from (select id, target_id, n_cands, unnest(case when contains(cleaned_html,'workflow-context') or contains(cleaned_html,'completed-fields') then [1] else [1,2,3] end) as aug from decisions) d join candidates c on c.id=d.id),
tp as (select id, aug, p as tp, tag as ttag from cp where candidate_id=target_id), hp as (select cp.id, cp.aug, tp, min(p) filter (where p<>tp and tag=ttag) as hn, case when tp>0 then tp-1 else tp+1 end as sw from cp join tp on tp.id=cp.id and tp.aug=cp.aug group by cp.id, cp.aug, tp),
fin as (select cp.id, cp.aug, candidate_id, (case when hn is null or sw >= n_cands then p when p=hn then sw when p=sw then hn else p end)::int as new_pos from cp join hp on hp.id=cp.id and hp.aug=cp.aug)"""


@query("q11_9_augment_shuffle", once(_AUG) + " select id, aug, new_pos, candidate_id from fin")
def _(fx):
    d = rw.with_html_type(fx.decisions.select("id", "cands", "target_id", "cleaned_html")).drop("cleaned_html")
    a = cp.augment_shuffle(d, 1, 3)
    return a.select("id", "aug", F.posexplode("cands").alias("new_pos", "c")).select("id", "aug", "new_pos", "c.candidate_id")


_HASH = "('0x' || substr(md5(concat('42|', id)),1,8))::bigint"


@query("q11_10_corrupt_op", f"select id, case when op<>'CLICK' and {_HASH}/4294967296.0::double < 0.33 then 'CLICK' else op end as bad_op, case when op<>'CLICK' and {_HASH}/4294967296.0::double < 0.33 then '' else value end as bad_value from decisions")
def _(fx):
    b = cp.corrupt_op(F.col("op"), F.col("value"), F.col("id"))
    return fx.decisions.select("id", b.alias("b")).select("id", F.col("b.op").alias("bad_op"), F.col("b.value").alias("bad_value"))


@query("q11_11_corpus_answers", f"with {_SHORT}, {_TGT}" + f""", an as (select id, concat('<think>', chr(10), {_WHY}, chr(10), '</think>', chr(10), '{{"op":"', op, '","choice":', choice, ',"value":"', value, '"}}') as output from el)
select d.id, {_prompt_sql()} as instruction, '' as input, an.output from decisions d join ls on ls.id=d.id join wf on wf.id=d.id join an on an.id=d.id left join sh on sh.id=d.id""")
def _(fx):
    return cp.build_corpus(fx.decisions.select(*COLS), "answers", shuffle_n=0).select("id", "instruction", "input", "output")


def _preference(fx):
    return cp.build_corpus(dom.with_places(fx.decisions.select(*COLS)), "preference")


def _preference_sql() -> str:
    """Every copy's list and sentences by the positions of that copy; the wrong answer is chosen once, on the original order."""
    line = _LINE.replace("cand_pos", "new_pos")
    bad = f"case when d.op <> 'CLICK' and {_HASH.replace('id)', 'd.id)')}/4294967296.0::double < 0.33 then {{}} else {{}} end"

    def side(c, op, value):
        el = f"concat({c}.tag, ' number ', {c}.new_pos + 1, ' (', substr({c}.lab, 1, 20), ')')"
        con = f"case when {c}.sim is null then '' else {_fill(cp.CONTRAST, f'{c}.sim')} end"
        place = f"case when {c}.placed then {_fill(cp.PLACE, _q('section#current workflo'))} else '' end"
        why = _said(cp.REASON, "substr(trim(d.task), 1, 40)", el, place, con, f"substr({value}, 1, 20)").replace("case op", f"case {op}")
        return f"""concat('<think>', chr(10), substr({why}, 1, 200), chr(10), '</think>', chr(10), '{{"op":"', {op}, '","choice":', {c}.new_pos + 1, ',"value":"', {value}, '"}}')"""

    return (_AUG + ", " + _HARD.strip()[len("with "):].replace("{near}", "case when near then 1.5 else 0 end") + f""",
 po as materialized (select id, aug, candidate_id, new_pos from fin union all select c.id, 0, c.candidate_id, c.cand_pos from candidates c join decisions d on d.id = c.id),
 pc as (select po.aug, po.new_pos, c.*, case when trim(c.text) <> '' then trim(c.text) else c.label end as lab, d.id % 3 = 0 and c.tag = 'input' and c.name = tn.name as placed
  from po join candidates c on c.candidate_id = po.candidate_id and c.id = po.id join decisions d on d.id = c.id join candidates tn on tn.id = d.id and tn.candidate_id = d.target_id),
 ps as materialized (select *, case when min(new_pos) over (partition by id, aug, tag) <> new_pos then min(new_pos) over (partition by id, aug, tag) + 1 else min(new_pos) over (partition by id, aug, tag order by new_pos rows between 1 following and unbounded following) + 1 end as sim from pc),
 pl as (select id, aug, string_agg({line}, chr(10) order by new_pos) as listed from ps group by id, aug), {_SHORT.replace("ls as (", "ls0 as (").replace("hp as (", "hs as (").replace("from hp)", "from hs)")}
 select d.id, g.aug::int as aug, case when d.id % 3 = 0 then 'workflow' else 'real_web' end as html_type, md5('### Instruction:' || chr(10) || {_prompt_sql().replace("listed", "pl.listed")} || chr(10) || chr(10) || '### Response:' || chr(10)) as prompt_digest,
  {side("g", "d.op", "d.value")} as chosen, {side("w", "(" + bad.format("'CLICK'", "d.op") + ")", "(" + bad.format("''", "d.value") + ")")} as rejected
 from hn join decisions d on d.id = hn.id join ps g on g.id = d.id and g.candidate_id = d.target_id join candidates wc on wc.id = hn.id and wc.cand_pos = hn.neg_pos join ps w on w.id = d.id and w.aug = g.aug and w.candidate_id = wc.candidate_id
 join pl on pl.id = d.id and pl.aug = g.aug join wf on wf.id = d.id left join sh on sh.id = d.id""")


@query("q11_11_corpus_preference", _preference_sql())
def _(fx):
    c = _preference(fx)
    return c.select("id", "aug", "html_type", F.md5("prompt").alias("prompt_digest"), "chosen", "rejected")


@query("q11_11_corpus_counts", _HARD.replace("{near}", "0") + """ select html_type, aug, count(*) as n from (select d.id, case when contains(cleaned_html,'workflow-context') or contains(cleaned_html,'completed-fields') then 'workflow' else 'real_web' end as html_type from decisions d join hn on hn.id=d.id) x
 join (select unnest([0,1,2,3]) as aug) a on a.aug <= case when html_type='workflow' then 1 else 3 end group by 1,2""")
def _(fx):
    return cp.build_corpus(fx.decisions.select(*COLS), "preference").groupBy("html_type", "aug").agg(F.count(F.lit(1)).alias("n"))


@query("q11_11_corpus_skipped", "select count(*) as rows, count(*) filter (where id % 19 <> 0) as used, count(*) filter (where id % 19 = 0) as skipped from decisions")
def _(fx):
    return cp.skipped(fx.decisions.select("id", "cands", F.when(F.col("id") % 19 == 0, "gone").otherwise(F.col("target_id")).alias("target_id")))


@query("q12_10_prompt_tokens", f"with {_SHORT}, pr as (select {_prompt_sql()} as prompt from decisions d join ls on ls.id=d.id join wf on wf.id=d.id left join sh on sh.id=d.id) select round(avg(length(prompt)*0.25::double),4) as mean_tokens, max(length(prompt))*0.25::double as max_tokens, count(*) filter (where length(prompt)*0.25 > 256) as over_limit, round(avg((length(prompt)*0.25 > 256)::int),6) as over_share from pr")
def _(fx):
    p = ev.prompt_length(cp.build_prompt(fx.decisions.select(*COLS)), limit=256)
    return p.select(F.round("mean_tokens", 4).alias("mean_tokens"), F.col("max_tokens").cast("double").alias("max_tokens"), "over_limit", r6("over_share").alias("over_share"))
