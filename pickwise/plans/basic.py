"""Queries over scans, projections, joins, parsing and scalar text functions."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import parse as ps, text as tx
from ..operators import rank as rk, rows as rw, split as sp
from ..sources import io
from ..sources.schema import CANDIDATES
from .registry import TRAIN_SITES, query, sql_common, sql_jaccard, sql_toks, sql_tokset, sql_words, sql_wordset


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- scans

@query("q1_1_read_decisions", """
select cast(id as varchar) as id, site_token, task, history, op, target_id, value from decisions""")
def _(fx):
    return io.fill_text(fx.decisions.select(F.col("id").cast("string").alias("id"), *rw.KEEP[1:]))


@query("q1_3_require", "select id, history from (select id, nullif(history,'') as history from decisions) where history is not null")
def _(fx):
    return io.require(fx.decisions.select("id", F.nullif("history", F.lit("")).alias("history")), "history")


@query("q1_4_with_id", "select page_id as id, url from pages", needs=None)
def _(fx):
    return io.with_id(fx.table("pages").select("page_id", "url"))


@query("q1_9_parse_candidates", """
select id, cand_pos, case when id % 10 = 3 then '' else candidate_id end as candidate_id, case when id % 10 = 3 then '' else attrs end as attrs,
  n from (select c.*, case when id % 10 = 3 then 0 else count(*) over (partition by id) end as n from candidates c join (select id as did from decisions) d on did = id)
where id % 10 <> 3 or cand_pos = 0""")
def _(fx):
    # one row in ten is cut short, so that malformed text is met on the way
    src = F.when(F.col("id") % 10 == 3, F.expr("left(candidate_elements, length(candidate_elements) - 2)")).otherwise(F.col("candidate_elements"))
    d = io.parse_candidates(fx.decisions.select("id", src.alias("candidate_elements")))
    return d.select("id", F.size("cands").cast("long").alias("n"), F.posexplode_outer("cands").alias("cand_pos", "c")).select(
        "id", F.coalesce("cand_pos", F.lit(0)).alias("cand_pos"), tx.text("c.candidate_id").alias("candidate_id"),
        tx.text("c.attrs").alias("attrs"), "n")


_OPEN = """from (select c.*, id % 10 = 3 as cut, id % 7 = 2 as more from candidates c join (select id as did from decisions) d on did = id) x"""


@query("q1_9_parse_open", f"""select id, cand_pos, concat(attrs, case when more then concat(' | rank=', cand_pos, ' | seen={{{{"at":[1,null]}}}}') else '' end) as attrs from (select *, not cut as keep {_OPEN}) y where keep""".replace("{{", "{").replace("}}", "}"))
def _(fx):
    # one row in seven has candidates with two keys of its own, one row in ten is cut short
    more = F.to_json(F.transform(F.from_json("candidate_elements", CANDIDATES), lambda c, i: F.struct(
        c["candidate_id"].alias("candidate_id"), c["tag"].alias("tag"), c["text"].alias("text"), c["attrs"].alias("attrs"), i.alias("rank"),
        F.struct(F.array(F.lit(1), F.lit(None).cast("int")).alias("at")).alias("seen"))))
    src = F.when(F.col("id") % 10 == 3, F.expr("left(candidate_elements, length(candidate_elements) - 2)")).when(F.col("id") % 7 == 2, more).otherwise(F.col("candidate_elements"))
    good, _ = io.parse_candidates_open(fx.decisions.select("id", src.alias("candidate_elements")))
    return io.with_extra_keys(good).select("id", F.posexplode("cands").alias("cand_pos", "c")).select("id", "cand_pos", "c.attrs")


@query("q1_9_rejects", "select id, 'malformed' as reason from decisions where id % 10 = 3")
def _(fx):
    src = F.when(F.col("id") % 10 == 3, F.expr("left(candidate_elements, length(candidate_elements) - 2)")).otherwise(F.col("candidate_elements"))
    return io.parse_candidates_open(fx.decisions.select("id", src.alias("candidate_elements")))[1].select("id", "reason")


# ---------------------------------------------------------------- projections and filters

@query("q2_1_explode_candidates", """
select c.id, cast(d.n_cands as int) as n_cands, cand_pos, candidate_id, tag, text, attrs,
  cast(candidate_id = target_id as int) as is_target
from candidates c join decisions d on c.id = d.id""")
def _(fx):
    return rw.explode_candidates(fx.decisions)


@query("q2_2_exclude_sites", "select id, site_token from decisions where site_token not in ('NATION_1','NATION_7')")
def _(fx):
    return rw.exclude_sites(fx.decisions.select("id", "site_token"), ["NATION_1", "NATION_7"])


@query("q2_3_html_type", """select id, case when contains(cleaned_html,'workflow-context') or contains(cleaned_html,'completed-fields')
 then 'workflow' else 'real_web' end as html_type from decisions""")
def _(fx):
    return rw.with_html_type(fx.decisions.select("id", "cleaned_html")).drop("cleaned_html")


@query("q2_4_site_seen", f"select id, site_token, site_token in {TRAIN_SITES} as site_seen from decisions")
def _(fx):
    d = fx.decisions.select("id", "site_token")
    return rw.with_site_seen(d, sp.group_split(d).filter("not is_valid"))


@query("q2_5_filter_ops", "select id, op from decisions where op in ('TYPE','SELECT')")
def _(fx):
    return rw.filter_ops(fx.decisions.select("id", "op"))


@query("q2_6_value_in_task", """select op, count(*) as n, sum(case when value <> '' and contains(lower(task), trim(lower(value))) then 1 else 0 end)::bigint as n_in_task
from decisions group by op""")
def _(fx):
    return fx.decisions.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(rw.value_in_task()).alias("n_in_task"))


@query("q2_7_empty_candidate", """select count(*) as n, round(avg(share),6) as empty_share from (select c.id,
  avg(case when trim(text)='' and trim(attrs)='' then 1.0 else 0.0 end) as share from candidates c join decisions d on c.id=d.id group by c.id)""")
def _(fx):
    share = F.size(F.filter("cands", rw.empty_candidate)) / F.size("cands")
    return fx.decisions.filter(F.size("cands") > 0).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(share)).alias("empty_share"))


@query("q2_8_clean_submission", r"""
select id, case when o in ('CLICK','TYPE','SELECT') then o else 'CLICK' end as op, coalesce(t,'') as target_id,
 case when o in ('TYPE','SELECT') then trim(regexp_replace(v, '[\n\r]', ' ', 'g')) else '' end as value
from (select id, case when id % 17 = 0 then 'hover' else op end as o, case when id % 13 = 0 then null else target_id end as t,
  concat(' ', value, chr(10), 'x ') as v from decisions)""")
def _(fx):
    return rw.clean_submission(fx.decisions.select(
        "id", F.when(F.col("id") % 17 == 0, "hover").otherwise(F.col("op")).alias("op"),
        F.when(F.col("id") % 13 != 0, F.col("target_id")).alias("target_id"),
        F.concat(F.lit(" "), "value", F.lit("\nx ")).alias("value")))


@query("q2_9_sample_n", "select id, op from decisions order by md5(concat('42|', id)), id limit 500")
def _(fx):
    return rw.sample_n(fx.decisions.select("id", "op"), 500)


# ---------------------------------------------------------------- joins

@query("q3_1_align_to_ids", """select o_orderkey as id, coalesce(op,'CLICK') as op, coalesce(target_id,'') as target_id, coalesce(value,'') as value
from orders left join decisions on id = o_orderkey""")
def _(fx):
    ids = fx.table("orders").select(F.col("o_orderkey").alias("id"))
    return rw.align_to_ids(ids, fx.decisions.select("id", "op", "target_id", "value"))


@query("q3_2_join_test", "select v.id, v.op, v.target_id, d.site_token from votes v join decisions d on v.id=d.id where v.fold=0", needs="decisions votes")
def _(fx):
    sub = fx.votes.filter("fold = 0").select("id", "op", "target_id")
    return rw.join_test(sub, fx.decisions.select("id", "site_token"))


@query("q3_3_attach_row", """select c.id, c.candidate_id, md.p from candidates c join
 (select id, round(length(task) / 100.0, 6) as p from decisions) md on md.id=c.id""")
def _(fx):
    rows = fx.decisions.select("id", r6(F.length("task") / 100.0).alias("p"))
    cand = rw.explode_candidates(fx.decisions, with_label=False).select("id", "candidate_id")
    return rw.attach_row(cand, rows)


@query("q3_4_lookup_default", """with p as (select tag, count(*)::double / 1000 as w from candidates where tag in ('a','input') group by tag)
select c.candidate_id, c.tag, round(coalesce(w, 0.0001), 6) as w from candidates c join decisions d on c.id = d.id left join p on p.tag = c.tag""")
def _(fx):
    cand = rw.explode_candidates(fx.decisions, with_label=False).select("candidate_id", "tag")
    dim = cand.filter(F.col("tag").isin("a", "input")).groupBy("tag").agg((F.count(F.lit(1)) / 1000).alias("w"))
    # every line belongs to a decision, so both sides count the same candidates
    return rw.lookup(cand, dim, "tag", "w", 1e-4).withColumn("w", r6("w")).select("candidate_id", "tag", "w")


@query("q3_5_prediction_map", """select d.id, coalesce(v.target_id,'') as target_id from decisions d left join
 (select * from votes where fold = 1 and op <> 'CLICK') v on v.id = d.id""", needs="decisions votes")
def _(fx):
    best = fx.votes.filter("fold = 1 and op <> 'CLICK'").select("id", "target_id")
    return fx.decisions.select("id").join(best, "id", "left").withColumn("target_id", tx.text("target_id"))


@query("q3_6_attach_target", """select d.id, c.tag as target_tag, case when trim(c.text) <> '' then trim(c.text) else c.label end as target_label
from decisions d left join candidates c on c.id=d.id and c.candidate_id=d.target_id""")
def _(fx):
    t = rw.candidate_of("target_id")
    return fx.decisions.select("id", t.alias("c")).select(
        "id", F.col("c.tag").alias("target_tag"), ps.candidate_label(F.col("c"), ps.EXAMPLE_LABEL_CHAIN, lower=False).alias("target_label"))


@query("q3_7_target_present", """select v.id, exists (select 1 from candidates c where c.id=v.id and c.candidate_id=v.tid) as target_present
from (select id, case when id % 9 = 0 then 'gone' else target_id end as tid from decisions) v""")
def _(fx):
    d = fx.decisions.select("id", "cands", F.when(F.col("id") % 9 == 0, "gone").otherwise(F.col("target_id")).alias("target_id"))
    return rw.with_target_present(d).select("id", "target_present")


@query("q3_9_cosine_topk", """with v as (select vec_id, label, embedding::double[] as e from embeddings), q as (select label, e from v qualify row_number() over (partition by label order by vec_id) = 1),
s as (select v.label as id, v.vec_id as item_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e,q.e) * list_dot_product(v.e,v.e)), 9) as c from v join q on q.label = v.label)
select cast(id as int) as id, item_id, round(c, 6) as cosine, cast(rn as int) as rank from (select *, row_number() over (partition by id order by c desc, item_id) as rn from s) where rn <= 5""", needs=None)
def _(fx):
    e = fx.table("embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("item_id"))
    q = e.withColumn("n", first).filter("n = 1").select("id", F.col("v").alias("q"))
    return rk.cosine_topk(q, e, 5).withColumn("cosine", r6("cosine"))


# ---------------------------------------------------------------- extraction

@query("q4_1_parse_history", r"""
with p as (select id, unnest(string_split(history, ' | ')) as s, generate_subscripts(string_split(history, ' | '), 1) as i from decisions where history <> '')
select id, cast(i - 1 as int) as step_pos, regexp_extract(s, '\[([^\]]+)\]', 1) as tag, trim(regexp_extract(s, '\] (.*?) ?-> ', 1)) as text,
 regexp_extract(s, '-> (\w+)', 1) as op, trim(regexp_extract(s, '-> \w+: (.*)$', 1)) as value from p""")
def _(fx):
    d = fx.decisions.select("id", F.posexplode(ps.history_steps("history")).alias("step_pos", "s"))
    return d.select("id", "step_pos", "s.*")


@query("q4_1_history_summary", r"""
with p as (select id, generate_subscripts(string_split(history, ' | '), 1) as i, unnest(string_split(history, ' | ')) as s from decisions where history <> ''),
q as (select id, i, regexp_extract(s, '\[([^\]]+)\]', 1) as tag, trim(regexp_extract(s, '\] (.*?) ?-> ', 1)) as text, regexp_extract(s, '-> (\w+)', 1) as op from p)
select d.id, cast(coalesce(n,0) as int) as n_steps, coalesce(last_tag,'') as last_tag, coalesce(last_op,'') as last_op, coalesce(ops,'') as hist_ops, coalesce(texts,'') as hist_texts
from decisions d left join (select id, count(*) as n, last(tag order by i) as last_tag, last(op order by i) as last_op, string_agg(op, ' ' order by i) as ops,
 string_agg(text, ' ' order by i) as texts from q group by id) h on h.id=d.id""")
def _(fx):
    s = F.col("steps")
    return fx.decisions.select("id", ps.history_steps("history").alias("steps")).select(
        "id", F.size(s).alias("n_steps"), ps.last_step(s, "tag").alias("last_tag"), ps.last_step(s, "op").alias("last_op"),
        ps.joined_steps(s, "op").alias("hist_ops"), ps.joined_steps(s, "text").alias("hist_texts"))


@query("q4_2_parse_attrs", """
with p as (select c.id, cand_pos, unnest(string_split(attrs, ' | ')) as s from candidates c join decisions d on d.id=c.id)
select id, cand_pos, split_part(s, '=', 1) as k, trim(substr(s, strpos(s,'=')+1)) as v from p""")
def _(fx):
    cand = rw.explode_candidates(fx.decisions, with_label=False)
    return cand.select("id", "cand_pos", F.explode(ps.attr_pairs("attrs")).alias("p")).select("id", "cand_pos", "p.k", "p.v")


@query("q4_3_first_attr", "select c.id, cand_pos, name, label, opts as options from candidates c join decisions d on d.id = c.id")
def _(fx):
    cand = rw.explode_candidates(fx.decisions, with_label=False)
    return cand.select("id", "cand_pos", *[ps.first_attr("attrs", k).alias(k) for k in ("name", "label", "options")])


@query("q4_4_parse_options", """select c.id, cand_pos, cast(case when opts='' then 0 else len(string_split(opts,' / ')) end as int) as n_spaced,
 array_to_string(string_split(opts,' / '),';') as spaced, array_to_string(list_transform(string_split(opts,'/'), lambda x: trim(x)),';') as slashed from candidates c join decisions d on d.id=c.id""")
def _(fx):
    cand = rw.explode_candidates(fx.decisions, with_label=False)
    spaced = ps.options("attrs")
    return cand.select("id", "cand_pos", F.size(spaced).alias("n_spaced"), F.array_join(spaced, ";").alias("spaced"),
                       F.array_join(ps.options("attrs", "/"), ";").alias("slashed"))


@query("q4_5_history_signature", r"""select id, case when trim(history)='' then 'START' when len(regexp_extract_all(history,'->\s*(CLICK|TYPE|SELECT)',1)) > 0
 then array_to_string(regexp_extract_all(history,'->\s*(CLICK|TYPE|SELECT)',1),',') else concat('STEP_', len(regexp_extract_all(history,'Step \d+:')) + 1) end as sig from decisions""")
def _(fx):
    return fx.decisions.select("id", ps.history_signature("history").alias("sig"))


@query("q4_6_n_steps", r"select id, cast(len(regexp_extract_all(history,'Step \d+:')) as int) as n from decisions")
def _(fx):
    return fx.decisions.select("id", ps.n_steps("history").alias("n"))


@query("q4_7_compress_history", r"""
with p as (select id, generate_subscripts(string_split(history, ' | '), 1) as i, unnest(string_split(history, ' | ')) as s from decisions where history <> ''),
q as (select id, i, regexp_extract(s, '\[([^\]]+)\]', 1) as tag, substr(trim(regexp_extract(s, '\] (.*?) ?-> ', 1)),1,30) as text, regexp_extract(s, '-> (\w+)', 1) as op,
 substr(trim(regexp_extract(s, '-> \w+: (.*)$', 1)),1,20) as value from p)
select d.id, coalesce(t, 'None') as short from decisions d left join (select id, string_agg(concat('[',tag,']', case when text='' then '' else ' '||text end, '→', op, case when value<>'' and op<>'CLICK' then ':'||value else '' end), ' | ' order by i) as t from q group by id) x on x.id=d.id""")
def _(fx):
    return fx.decisions.select("id", ps.compress_history("history").alias("short"))


@query("q4_8_html_context", r"""
with w as (select id, cleaned_html as h, regexp_extract(cleaned_html, '(?i)Completed:\s*([^<\n]+)', 1) as done from decisions)
select id, cast(length(h) as int) as html_len, cast(coalesce(try_cast(regexp_extract(h,'(?i)step\s+(\d+)\s+of\s+(\d+)',1) as int),0) as int) as cur_step,
 cast(coalesce(try_cast(regexp_extract(h,'(?i)step\s+(\d+)\s+of\s+(\d+)',2) as int),0) as int) as tot_step,
 cast(len(list_distinct(list_filter(list_transform(string_split(done,','), lambda x: lower(trim(x))), lambda x: x<>''))) as int) as n_completed,
 lower(regexp_extract(h,'(?is)<section[^>]*aria-label="current workflow panel"[^>]*>.*?\bname="([^"]+)"',1)) as panel,
 array_to_string(list_sort(""" + sql_tokset(r"""array_to_string(regexp_extract_all(h,'(?i)<h1[^>]*>([^<]+)</h1>',1),' ')""") + r"""),' ') as h1,
 array_to_string(list_sort(""" + sql_tokset(r"""array_to_string(regexp_extract_all(h,'(?i)<aside[^>]*class="workflow-context"[^>]*>([^<]+)</aside>',1),' ')""") + r"""),' ') as ctx from w""")
def _(fx):
    d = fx.decisions.select("id", ps.html_context("cleaned_html").alias("x"))
    return d.select("id", "x.html_len", "x.cur_step", "x.tot_step", F.size("x.completed").alias("n_completed"),
                    F.array_join("x.panel_names", " ").alias("panel"), F.array_join(F.array_sort("x.h1_tokens"), " ").alias("h1"),
                    F.array_join(F.array_sort("x.ctx_tokens"), " ").alias("ctx"))


@query("q4_9_candidate_label", """select c.id, cand_pos, lower(case when trim(text)<>'' then trim(text) else label end) as full_chain,
 case when trim(text)<>'' then trim(text) else label end as example_chain from candidates c join decisions d on d.id=c.id""")
def _(fx):
    d = fx.decisions.select("id", F.posexplode("cands").alias("cand_pos", "c"))
    return d.select("id", "cand_pos", ps.candidate_label(F.col("c")).alias("full_chain"),
                    ps.candidate_label(F.col("c"), ps.EXAMPLE_LABEL_CHAIN, lower=False).alias("example_chain"))


@query("q4_10_candidate_description", """select c.id, cand_pos, concat(trim(concat(tag,' ',case when trim(text)<>'' then trim(text) else label end)),
 case when opts='' then '' else concat(' choices: ', substr(opts,1,60)) end) as description from candidates c join decisions d on d.id=c.id""")
def _(fx):
    d = fx.decisions.select("id", F.posexplode("cands").alias("cand_pos", "c"))
    return d.select("id", "cand_pos", ps.candidate_description(F.col("c")).alias("description"))


_RESP = """
with x as (select r.id, split_part(response,'</think>',2) as tail, contains(response,'</think>') as thought, response from responses r),
b as (select id, list_last(list_filter(regexp_extract_all(case when thought then tail else response end, '\\{[^{}]*\\}'), lambda j: json_valid(j))) as j from x),
p as (select id, case when upper(j->>'$.op') in ('CLICK','TYPE','SELECT') then upper(j->>'$.op') else 'CLICK' end as op, coalesce(j->>'$.choice','') as choice, coalesce(j->>'$.value','') as v from b)
"""


@query("q4_17_parse_response", _RESP + "select id, op, choice, case when op='CLICK' then '' else v end as value from p", needs="responses")
def _(fx):
    return fx.responses.select("id", ps.parse_response("response").alias("a")).select("id", "a.*")


@query("q4_17_parse_response_first", r"""
with b as (select id, regexp_extract(response, '(?s)\{.*?\}') as b from responses), v as (select id, case when json_valid(b) then b end as j from b),
p as (select id, case when upper(j->>'$.op') in ('CLICK','TYPE','SELECT') then upper(j->>'$.op') else 'CLICK' end as op, coalesce(j->>'$.choice','') as choice, coalesce(j->>'$.value','') as v from v)
select id, op, choice, case when op='CLICK' then '' else v end as value from p""", needs="responses")
def _(fx):
    return fx.responses.select("id", ps.parse_response("response", "first").alias("a")).select("id", "a.*")


@query("q4_17_parse_response_greedy", r"""
with b as (select id, regexp_extract(response, '(?s)\{.*\}') as b from responses), v as (select id, case when json_valid(b) then b end as j from b),
p as (select id, case when upper(j->>'$.op') in ('CLICK','TYPE','SELECT') then upper(j->>'$.op') else 'CLICK' end as op, coalesce(j->>'$.choice','') as choice, coalesce(j->>'$.value','') as v from v)
select id, op, choice, case when op='CLICK' then '' else v end as value from p""", needs="responses")
def _(fx):
    return fx.responses.select("id", ps.parse_response("response", "greedy").alias("a")).select("id", "a.*")


@query("q4_18_decode_choice", _RESP + """select p.id, p.op, coalesce(c.candidate_id,'') as target_id from p left join candidates c
 on c.id=p.id and c.cand_pos = try_cast(p.choice as int) - 1""", needs="responses")
def _(fx):
    r = fx.responses.select("id", ps.parse_response("response").alias("a"))
    return r.join(fx.decisions.select("id", "cands"), "id").select(
        "id", "a.op", ps.decode_choice("a.choice", "cands").alias("target_id"))


# ---------------------------------------------------------------- scalar text functions

@query("q5_1_token_set", "select doc_id, cast(len(s) as int) as n, md5(array_to_string(list_sort(s),' ')) as digest from (select doc_id, " + sql_wordset("text") + " as s from documents)", needs=None)
def _(fx):
    d = fx.table("documents").select("doc_id", tx.word_set("text").alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.array_sort("s"), " ")).alias("digest"))


@query("q5_2_tokenize", "select doc_id, cast(len(s) as int) as n, md5(array_to_string(s,' ')) as digest from (select doc_id, " + sql_toks("text") + " as s from documents)", needs=None)
def _(fx):
    d = fx.table("documents").select("doc_id", tx.tokenize("text").alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", " ")).alias("digest"))


_SETS = "with s as (select id, " + sql_tokset("task") + " as t, " + sql_tokset("history") + " as h from decisions) "


def _sets(fx):
    return fx.decisions.select("id", tx.token_set("task").alias("t"), tx.token_set("history").alias("h"))


_T, _H = F.col, F.col


@query("q5_3_coverage", _SETS + "select id, case when len(t)=0 then 0.0 else round(" + sql_common("t", "h") + "::double/len(t),6) end as coverage, case when len(h)=0 then null else round(" + sql_common("t", "h") + "::double/len(h),6) end as coverage_or_null from s")
def _(fx):
    t, h = F.col("t"), F.col("h")
    return _sets(fx).select("id", r6(tx.coverage(t, h)).alias("coverage"), r6(tx.coverage(h, t, None)).alias("coverage_or_null"))


@query("q5_4_overlap_ratio", _SETS + "select id, case when len(h)=0 then 0.0 else round(" + sql_common("t", "h") + "::double/len(h),6) end as overlap from s")
def _(fx):
    return _sets(fx).select("id", r6(tx.overlap_ratio(F.col("t"), F.col("h"))).alias("overlap"))


@query("q5_5_jaccard", _SETS + "select id, round(" + sql_jaccard("t", "h") + ",6) as jaccard from s")
def _(fx):
    return _sets(fx).select("id", r6(tx.jaccard(F.col("t"), F.col("h"))).alias("jaccard"))


@query("q5_6_dice", _SETS + "select id, case when len(t)+len(h)=0 then 0.0 else round(2*" + sql_common("t", "h") + "::double/(len(t)+len(h)),6) end as dice from s")
def _(fx):
    return _sets(fx).select("id", r6(tx.dice(F.col("t"), F.col("h"))).alias("dice"))


@query("q5_7_overlap_min", _SETS + "select id, case when least(len(t),len(h))=0 then 0.0 else round(" + sql_common("t", "h") + "::double/least(len(t),len(h)),6) end as overlap_min from s")
def _(fx):
    return _sets(fx).select("id", r6(tx.overlap_min(F.col("t"), F.col("h"))).alias("overlap_min"))


@query("q5_8_remaining", "with s as (select d.id, cand_pos, " + sql_tokset("task") + " as t, " + sql_tokset("history") + " as h, " + sql_tokset("text || ' ' || attrs") + """ as e from decisions d join candidates c on c.id=d.id),
r as (select id, cand_pos, list_filter(t, lambda x: not list_contains(h, x)) as r, e from s)
select id, cand_pos, cast(len(r) as int) as n_open, case when len(e)=0 or len(r)=0 then 0.0 else round(len(list_intersect(r,e))::double/len(e),6) end as open_overlap from r""")
def _(fx):
    d = rk.with_token_sets(fx.decisions.select("id", "task", "history", "cands"))
    return d.select("id", F.size("r").alias("n_open"), "r", F.posexplode("ctoks").alias("cand_pos", "e")).select(
        "id", "cand_pos", "n_open", r6(tx.overlap_ratio(F.col("r"), F.col("e"))).alias("open_overlap"))


def _count_sql(col, k):
    return f"cast((length(lower({col})) - length(replace(lower({col}),'{k}','')))/{len(k)} as int)"


def _stats_sql():
    w = r"'[\p{L}\p{N}_]+'"
    parts = ["cast(length(task) as int) as task_len", f"cast(len(regexp_extract_all(lower(task),{w})) as int) as task_words",
             "cast(length(history) as int) as hist_len", f"cast(len(regexp_extract_all(lower(history),{w})) as int) as hist_words",
             "cast(contains(task,'\"') as int) as task_has_dquote", "cast(contains(task,'''') as int) as task_has_squote",
             r"cast(regexp_matches(task,'\d') as int) as task_has_digit"]
    for g, ks in tx.KEYWORDS.items():
        parts.append("+".join(f"cast(contains(lower(task),'{k}') as int)" for k in ks) + f" as task_kw_{g}")
    parts += [_count_sql("history", g) + f" as hist_n_{g}" for g in tx.KEYWORDS]
    return ", ".join(parts)


@query("q5_10_text_stats", "select id, " + _stats_sql() + " from decisions")
def _(fx):
    return fx.decisions.select("id", *[c.alias(n) for n, c in tx.text_stats().items()])


@query("q5_11_truncate", "select id, case when length(task)<=50 then task else rtrim(substr(task,1,50)) || '...' end as short from decisions")
def _(fx):
    return fx.decisions.select("id", tx.truncate("task", 50).alias("short"))


@query("q5_15_step_numbers", r"""with w as (select id, cleaned_html as h, n_cands, target_pos from decisions), s as (select *, coalesce(try_cast(regexp_extract(h,'(?i)step\s+(\d+)\s+of\s+(\d+)',1) as int),0) as cur,
 coalesce(try_cast(regexp_extract(h,'(?i)step\s+(\d+)\s+of\s+(\d+)',2) as int),0) as tot from w)
select id, round(ln(1+length(h)),6) as html_len_log, cast(greatest(0,tot-cur) as int) as steps_left, round(target_pos::double/greatest(1,n_cands-1),6) as pos_norm from s""")
def _(fx):
    d = fx.decisions.select("id", ps.html_context("cleaned_html").alias("x"), "target_pos", "n_cands")
    return d.select("id", r6(F.log1p("x.html_len")).alias("html_len_log"),
                    F.greatest(F.lit(0), F.col("x.tot_step") - F.col("x.cur_step")).alias("steps_left"),
                    r6(F.col("target_pos") / F.greatest(F.lit(1), F.col("n_cands") - 1)).alias("pos_norm"))


@query("q5_16_vocab_index", """select tag, cast(case tag when 'input' then 0 when 'textarea' then 1 when 'select' then 2 when 'button' then 3 when 'a' then 4 when 'div' then 7 else 10 end as int) as tag_idx,
 cast(11 as int) as type_idx, count(*) as n from candidates group by 1,2,3""")
def _(fx):
    c = rw.explode_candidates(fx.decisions, with_label=False)
    return c.groupBy("tag", tx.vocab_index("tag", tx.TAG_VOCAB).alias("tag_idx"), ps.input_type_index("attrs").alias("type_idx")).agg(F.count(F.lit(1)).alias("n"))
