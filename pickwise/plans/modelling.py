"""Queries over splits, models, sinks and streams."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..operators import models as md, rank as rk, rows as rw, rules as rl, split as sp
from ..operators.features import V2_FEATURES
from ..session import scratch_dir
from ..sources import io
from ..sources.schema import OPS
from ..streaming import scoring as st
from .basic import r6
from .registry import once, query
from .scoring import BASE, _ANSWER, _CLICKABLE, _GUARD_OUT, _GUARD_TAIL, _LOOSE, _MATCH, _OPTS

COLS = (*BASE, "cleaned_html")


@query("q14_4_snake_folds", """with g as (select site_token, count(*) as size, md5(site_token) as h from decisions group by site_token), r as (select *, row_number() over (order by size desc, h, site_token) - 1 as i from g)
select site_token, size, (case when (i // 5) % 2 = 0 then i % 5 else 4 - i % 5 end)::int as fold from r""")
def _(fx):
    return sp.snake_folds(fx.decisions.select("site_token"))


@query("q14_4_balanced_folds", """with g as (select site_token, count(*) as size, md5(site_token) as h from decisions group by site_token), r as (select *, row_number() over (order by size desc, h, site_token) - 1 as i from g)
select (case when (i // 5) % 2 = 0 then i % 5 else 4 - i % 5 end)::int as fold, count(*) as n_groups, sum(size)::bigint as n_rows from r group by 1""")
def _(fx):
    return sp.fold_loads(fx.decisions.select("site_token"))


@query("q14_5_group_split", """with g as (select distinct site_token from decisions), r as (select *, row_number() over (order by md5(concat('42|', site_token)), site_token) as k, count(*) over () as n from g)
select d.id, r.k <= ceil(n*0.2) as is_valid from decisions d join r on r.site_token=d.site_token""")
def _(fx):
    return sp.group_split(fx.decisions.select("id", "site_token")).select("id", "is_valid")


@query("q14_6_row_split", "select id, row_number() over (order by md5(concat('0|', id)), id::varchar) <= floor(count(*) over () * 0.2) as is_valid from decisions")
def _(fx):
    return sp.row_split(fx.decisions.select("id"))


@query("q2_9_sample_exact", "select id from decisions order by md5(concat('42|', id)), id::varchar limit 700")
def _(fx):
    return sp.sample_exact(fx.decisions.select("id"), 700)


# ---------------------------------------------------------------- models
#
# A fitted number has no SQL form. Each query gives what SQL can state exactly: which rows were held out, their folds
# and counts, and whether the fitted part keeps its bounds. Model queries run the defaults of `operators.models`.

_ROW_VALID = "(select id from (select id, row_number() over (order by md5(concat('0|', id)), id::varchar) <= floor(count(*) over () * 0.2) as v from decisions) q where v)"


def _folds(k):
    return f"""f as (select site_token, (case when (i // {k}) % 2 = 0 then i % {k} else {k - 1} - i % {k} end)::int as fold from
 (select site_token, row_number() over (order by count(*) desc, md5(site_token), site_token) - 1 as i from decisions group by site_token) r)"""


def _share(c):
    """True for a value between 0 and 1."""
    return F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))


@query("q14_1_fit_op", f"select op, count(*) as n, true as in_bounds from decisions where id in {_ROW_VALID} group by op")
def _(fx):
    d = sp.row_split(fx.decisions.select(*COLS))
    fit = md.materialize(md.op_inputs(d.filter("not is_valid")), "op-train", compression="zstd")
    p = md.predict_op(md.fit_op(fit), md.op_inputs(d.filter("is_valid")))
    hit = p.join(d.select("id", "op"), "id").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("op") == F.col("pred_op")).cast("double")).alias("accuracy"))
    return hit.select("op", "n", _share("accuracy").alias("in_bounds"))


@query("q14_2_oof_proba", f"with {_folds(5)} select d.id, f.fold, 1.0::double as total, true as in_bounds from decisions d join f using (site_token)")
def _(fx):
    d = fx.decisions.select(*COLS)
    inputs = md.materialize(sp.with_fold(md.op_inputs(d).join(d.select("id", "site_token"), "id")), "oof-inputs")
    total, fine = sum((F.col(c) for c in md.PROBS), F.lit(0.0)), F.lit(True)
    for c in md.PROBS:
        fine = fine & _share(c)
    return md.oof_proba(inputs).select("id", "fold", r6(total).alias("total"), (fine & F.col("pred_op").isin(*OPS)).alias("in_bounds"))


_RANKED = f"select id, count(*) as n, 1::bigint as first, max(cand_pos) + 1 as last, true as in_bounds from candidates where id in {_ROW_VALID} group by id"


def _ranks(scored):
    """Ranks of the held-out candidates: they run from 1 to n, and the targets' NDCG lies between 0 and 1."""
    rows = scored.select("id", "is_target", F.col("pos").alias("cand_pos"), F.round("score", 9).alias("score"))
    quality = rk.ndcg(rk.target_rank(rows, "score")).select("ndcg5").scalar()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "cand_pos")))
    return ranked.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("r").cast("bigint").alias("first"), F.max("r").alias("last"), F.count("score").alias("k")).select(
        "id", "n", "first", "last", ((F.col("k") == F.col("n")) & quality.between(0.0, 1.0)).alias("in_bounds"))


@query("q14_3_pairwise_ranker", _RANKED)
def _(fx):
    return _ranks(md.fit_ranker_v2(fx.decisions.select(*COLS))[2])


@query("q14_3_pointwise_ranker", _RANKED)
def _(fx):
    return _ranks(md.fit_ranker_v2(fx.decisions.select(*COLS), kind="pointwise")[2])


@query("q14_3_listwise_ranker", _RANKED)
def _(fx):
    return _ranks(md.fit_ranker_v2(fx.decisions.select(*COLS), kind="listwise")[2])


@query("q14_1_fit_op_trees", f"select op, count(*) as n, true as in_bounds from decisions where id in {_ROW_VALID} group by op")
def _(fx):
    d = sp.row_split(fx.decisions.select(*COLS))
    p = md.fit_op_trees(md.op_inputs(d.filter("not is_valid"))).predict(md.op_inputs(d.filter("is_valid")))
    total, fine = sum((F.col(c) for c in md.PROBS), F.lit(0.0)), F.col("pred_op").isin(*OPS)
    for c in md.PROBS:
        fine = fine & _share(c)
    return p.join(d.select("id", "op"), "id").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.min(fine & (F.abs(total - 1) < 1e-9)).alias("in_bounds"))


@query("q8_15_feature_importance", "select unnest([" + ", ".join(f"'{f}'" for f in V2_FEATURES) + "]) as feature, 1.0::double as total, true as in_bounds", needs=None)
def _(fx):
    ranker, _, _ = md.fit_ranker_v2(fx.decisions.select(*COLS), kind="pointwise")
    imp = md.feature_importance(ranker, fx.spark)
    return imp.select("feature", F.round(imp.agg(F.sum("importance")).scalar(), 6).alias("total"), _share("importance").alias("in_bounds"))


@query("q14_7_cross_validate", f"""with {_folds(5)}, c as (select fold::varchar as fold, count(*)::double as n from decisions join f using (site_token) group by fold)
select fold, n, true as in_bounds from c union all select 'mean', avg(n), true from c""")
def _(fx):
    m = md.cross_validate(fx.decisions.select(*COLS))
    fine = F.lit(True)
    for c in ("op_acc", "target_id_acc", "value_acc"):
        fine = fine & _share(c) & (F.col("exact_match") <= F.col(c) + 1e-9)
    return m.select("fold", "n", (fine & _share("exact_match")).alias("in_bounds"))


@query("q14_8_fit_predict", """with g as (select distinct site_token from decisions), r as (select *, row_number() over (order by md5(concat('42|', site_token)), site_token) as k, count(*) over () as n from g)
select d.id, true as op_known, true as own_candidate from decisions d join r using (site_token) where r.k <= ceil(r.n*0.2)""")
def _(fx):
    d = sp.group_split(fx.decisions.select(*COLS))
    p = md.fit_predict(d.filter("not is_valid").drop("is_valid"), d.filter("is_valid").select("id", "site_token", "task", "history", "cleaned_html", "cands"))
    own = F.exists("cands", lambda c: c["candidate_id"] == F.col("target_id"))
    return p.join(fx.decisions.select("id", "cands"), "id").select("id", F.col("op").isin(*OPS).alias("op_known"), F.coalesce(own, F.lit(False)).alias("own_candidate"))


@query("q3_9_outside_scorer", "select c.candidate_id, round(length(c.text)::double / (1 + length(c.attrs)), 6) as score from candidates c join decisions d on d.id=c.id")
def _(fx):
    def score(frames):
        for f in frames:
            yield f[["candidate_id"]].assign(score=(f["text"].str.len() / (1 + f["attrs"].str.len())).round(6))

    cand = rw.explode_candidates(fx.decisions, False).select("candidate_id", "text", "attrs")
    return md.scored_by(cand, score, "candidate_id string, score double")


# ---------------------------------------------------------------- sinks and streams

def _out(fx, name):
    return f"{scratch_dir(fx.spark)}/pickwise/{fx.spark.sparkContext.applicationId}/out-{name}-{uuid.uuid4().hex[:12]}"


_SUB = "select id::varchar as id, op, target_id, case when op='CLICK' then '' else value end as value from votes where fold=0"


@query("q1_6_write_submission", _SUB, needs="decisions votes")
def _(fx):
    path = _out(fx, "submission")
    io.write_submission(rw.clean_submission(fx.votes.filter("fold = 0")), path)
    back = fx.spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.fillna("")


@query("q1_2_read_csv", "select id::varchar as id, site_token, task || chr(10) || 'é' as task, history, op, target_id, value from decisions")
def _(fx):
    path = _out(fx, "csv")
    d = fx.decisions.select(F.col("id").cast("string").alias("id"), "site_token", F.concat("task", F.lit("\né")).alias("task"), "history", F.lit("").alias("cleaned_html"), "candidate_elements", "op", "target_id", "value")
    d.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return io.read_decisions(fx.spark, path).drop("cleaned_html", "candidate_elements")


@query("q1_1_read_csv_ranges", "select id::varchar as id, site_token, task || chr(10) || '\"é\"' || chr(13) || chr(10) || ',' as task, history, op, target_id, value, n_cands::int as n_cands from decisions")
def _(fx):
    # read in ranges of 1 MB, so that records with line breaks and quotes lie across their borders; every task writes files of its own
    path, size = _out(fx, "csv"), "spark.sql.files.maxPartitionBytes"
    d = fx.decisions.select(F.col("id").cast("string").alias("id"), "site_token", F.concat("task", F.lit('\n"é"\r\n,')).alias("task"), "history", F.lit("").alias("cleaned_html"), "candidate_elements", "op", "target_id", "value")
    d.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    before = fx.spark.conf.get(size)
    fx.spark.conf.set(size, "1m")
    try:
        back = md.materialize(io.read_decisions(fx.spark, path, split=True), "csv-read")
    finally:
        fx.spark.conf.set(size, before)
    return io.parse_candidates(back).select("id", "site_token", "task", "history", "op", "target_id", "value", F.size("cands").alias("n_cands"))


@query("q1_7_write_corpus", "select case when contains(cleaned_html,'workflow-context') or contains(cleaned_html,'completed-fields') then 'workflow' else 'real_web' end as html_type, id, op from decisions")
def _(fx):
    path = _out(fx, "corpus")
    io.write_corpus(rw.with_html_type(fx.decisions.select("id", "op", "cleaned_html")).drop("cleaned_html"), path)
    return fx.spark.read.schema("id long, op string, html_type string").json(path)


@query("q1_8_write_metrics", "select 'overall' as slice, count(*) as n from decisions")
def _(fx):
    path = _out(fx, "metrics")
    io.write_metrics(fx.decisions.agg(F.lit("overall").alias("slice"), F.count(F.lit(1)).alias("n")), path)
    return fx.spark.read.schema("slice string, n long").json(path)


def _stream_source(fx):
    """Decision files as they would arrive, two for every core or more; cut where the table lies, so that no row is shuffled."""
    path = _out(fx, "arrivals")
    # without the page's text, which no query on arrivals reads: a missing column is read as null
    _deliver(fx.decisions.select(F.col("id").cast("string").alias("id"), "site_token", "task", "history", "candidate_elements"), path, 2)
    return path


def _deliver(df, path, per_core):
    files = per_core * df.sparkSession.sparkContext.defaultParallelism
    df.write.options(compression="zstd", maxRecordsPerFile=df.count() // files + 1).mode("append").parquet(path)


@query("q1_5_read_stream", "select id::varchar as id, length(task)::int as n from decisions")
def _(fx):
    src, out = _stream_source(fx), _out(fx, "copied")
    q = (io.read_decisions_stream(fx.spark, src).select("id", F.length("task").alias("n")).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", _out(fx, "ckpt")).trigger(availableNow=True).start(out))
    q.awaitTermination()
    return fx.spark.read.schema("id string, n int").parquet(out)


# the heuristic answers of all decisions, then the guard
_STREAMED = (_ANSWER + ", " + _MATCH.strip()[len("with "):] + _OPTS + """, p9 as (select an.id, false as bad_op_to_click, false as inv, pred_op as op, pred_target_id as target_id, pred_value as value from an)"""
             + _CLICKABLE + _GUARD_TAIL.replace("{src}", "p9"))


@query("q13_1_score_stream", once(_STREAMED) + "select id::varchar as id, op, target_id, case when op='CLICK' then '' else v2 end as value from g6")
def _(fx):
    out = _out(fx, "answers")
    st.score_stream(fx.spark, _stream_source(fx), out, _out(fx, "ckpt"), fx.spark.sparkContext.defaultParallelism).awaitTermination()
    batch = st.answer(fx.decisions.select(F.col("id").cast("string").alias("id"), "task", "history", "candidate_elements"))
    streamed = fx.spark.read.schema(batch.schema).parquet(out)
    return streamed.select("id", "op", "target_id", "value")


@query("q13_1_score_stream_once", once(_STREAMED) + "select id::varchar as id, op, target_id, case when op='CLICK' then '' else v2 end as value from g6")
def _(fx):
    # every file is delivered twice, and the second time dealt out otherwise
    src, out = _stream_source(fx), _out(fx, "answers")
    _deliver(fx.spark.read.parquet(src).coalesce(fx.spark.sparkContext.defaultParallelism + 1), src, 3)
    st.score_stream(fx.spark, src, out, _out(fx, "ckpt"), fx.spark.sparkContext.defaultParallelism, once_within="30 days").awaitTermination()
    return fx.spark.read.parquet(out).select("id", "op", "target_id", "value")


@query("q13_2_running_counts", _STREAMED + ", fl as (select op," + _GUARD_OUT.format(strict=_LOOSE) + " from g6), ct2 as (select concat('op=', op) as item, count(*) as n from fl group by op" + "".join(
    f" union all select '{f}', count(*) filter (where {f}) from fl" for f in rl.AUDIT) + ") select item, n from ct2 where n > 0")
def _(fx):
    out, counts = _out(fx, "answers"), _out(fx, "counts")
    st.score_stream(fx.spark, _stream_source(fx), out, _out(fx, "ckpt"), fx.spark.sparkContext.defaultParallelism).awaitTermination()
    schema = fx.spark.read.parquet(out).schema
    answers = fx.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(out)
    st.count_stream(answers, counts, _out(fx, "ckpt")).awaitTermination()
    return st.totals(fx.spark, counts)
