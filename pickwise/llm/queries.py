"""Registered queries of the operators: thin forms over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pickwise.llm import bpe, collide, langid, packing, ppm, prefixes, quotes, repair, rules, secrets, simhash, substring, warc
from pickwise.llm.common import fold, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op2_bpe_forced_boundaries")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_decision_list")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = rules.fit(docs, labels)
    return rules.apply_rules(rules.with_stats(docs), found).select("doc_id", *rules.BASE, "rule", "base_failed", "kept")


@query("op10_binary_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_simhash_bit_sliced")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_collision_projections")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collide.near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with docs as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents),
wins as (select doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) as k
         from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from docs where len(w) >= 50)),
firsts as (select k, min(doc_id) as m from wins group by k),
hit as (select w.doc_id, list(p) as ps from wins w join firsts f using (k) where f.m < w.doc_id group by w.doc_id),
gone as (select doc_id, list_distinct(flatten([range(p, p + 50) for p in ps])) as g from hit),
kept as (select d.doc_id, w, coalesce(g, []) as g from docs d left join gone using (doc_id))
select doc_id, cast(len(w) as bigint) as n_words, cast(len(g) as bigint) as n_removed,
  sha256(array_to_string([w[i] for i in range(1, len(w) + 1) if not list_contains(g, i)], ' ')) as kept_sha256
from kept
"""


@query("op1_substring_de_bruijn", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(table(spark, sf_dir, "documents"))


@query("op6_ppm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    return ppm.trie_score(table(spark, sf_dir, "documents"), ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_secret_forest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees, words = secrets.fit(docs, path_col="source")
    out = secrets.findings(docs, trees, words, path_col="source")
    return out.select("doc_id", "at", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "secret")


OP4_SQL = r"""
with recursive m as (select conv_id, turn, coalesce(text, '') as text, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as norm from conversations),
firsts as (select conv_id, norm, min(turn) as f from m group by conv_id, norm),
before as (select conv_id, turn, lag(norm) over (partition by conv_id order by turn) as prev from m),
up as (select b.conv_id, b.turn, f.f as reply from before b left join firsts f on f.conv_id = b.conv_id and f.norm = b.prev),
walk as (select conv_id, turn, reply, turn as root, 0 as depth from up where reply is null
         union all select u.conv_id, u.turn, u.reply, w.root, w.depth + 1 from up u join walk w on u.conv_id = w.conv_id and u.reply = w.turn)
select conv_id, turn, case when reply is not null then conv_id end as reply_thread, reply as reply_order, conv_id as root_thread, root as root_order,
  cast(depth as bigint) as depth, trim(text, chr(10)) as text
from walk join m using (conv_id, turn)
"""


@query("op4_quotation_links", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in mail form, each message under quotes of the two before it, linked and freed of quotes again."""
    return quotes.conversations(quotes.linked(quotes.quoting(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha1(h) as x, row_number() over same as nth, first_value(page_id) over same as first
      from p window same as (partition by h order by page_id nulls last))
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, i + 1, 5) as bigint) >> s) & 31 as int) + 1, 1) for s in [15, 10, 5, 0]], '')
                   for i in range(0, 40, 5)], '') as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then first end as refers_to
from d
"""


@query("op12_warc_segments", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


# crc32 of a string in SQL: the table of the reflected polynomial, then one step per byte
CRC_TABLE = """crc as (select list(v order by i) as tab from (select i, list_reduce(list_concat([i], range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i)))"""


def crc_sql(text: str) -> str:
    steps = f"list_concat([4294967295], [cast(ascii(x) as bigint) for x in string_split({text}, '')])"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
with {CRC_TABLE},
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
      from conversations where conv_id is not null),
c as (select conv_id, n, {crc_sql("cast(conv_id as varchar)")} % 6 as h, conv_id - conv_id % 100 as base from (select conv_id, count(*) as n from t group by conv_id), crc),
r as (select c.conv_id, b.i as d, role, text from c join t b on b.conv_id = c.base and b.i <= h
      union all select c.conv_id, least(c.h, coalesce(b.n, 0)) + t.i - c.h, role, text from t join c using (conv_id) left join c b on b.conv_id = c.base where t.i > c.h),
s as (select conv_id, d, length(text) as chars, string_agg(concat(length(role), ':', role, length(text), ':', text), '') over (partition by conv_id order by d) as key from r),
p as (select conv_id, d, chars, key, lag(key, 1, '') over (partition by conv_id order by d) as up, d = max(d) over (partition by conv_id) as ends from s
      union all select conv_id, 0, 0, '', null, conv_id not in (select conv_id from s) from c),
nodes as (select key, any_value(up) as up, any_value(d) as d, any_value(chars) as chars, min(conv_id) as rep, count(*) as n, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as e from p group by key),
kids as (select up as key, count(*) as k from nodes where up is not null group by up),
sub as (select a.key, sum(case when coalesce(k.k, 0) = 0 then 1 else 0 end) as leaves, sum((m.n - 1) * m.chars) as saved
        from nodes m left join kids k using (key) join p a on a.conv_id = m.rep and a.d <= m.d group by a.key)
select cast(n.rep as bigint) as conv_id, cast(n.d as bigint) as depth, u.rep as parent_conv_id, cast(n.n as bigint) as n_convs, cast(coalesce(k.k, 0) as bigint) as n_children,
  cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, n.e as ends_sha256
from nodes n join sub using (key) left join kids k using (key) left join nodes u on u.key = n.up
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def _op13_sql() -> str:
    """The dynamic program as a recursion over rows: per place the least (cost, audit, repaired text)."""
    kind = "struct(c bigint, s varchar, r varchar)"

    def grown(a, cost, op, *lines):
        return f"case when {a} is not null then {{'c': {a}.c + {cost}, 's': {a}.s || '{op}', 'r': {a}.r{''.join(f' || chr(10) || {x}' for x in lines)}}} end"

    u, a = "'user:'", "'assistant:'"
    to_user = ", ".join(["au", grown("a0", 5, "I", u), grown("s1", 5, "I", u), grown("aa", 5, "I", u)])
    to_assistant = ", ".join(["aa", grown("au", 5, "I", a), grown("a0", 10, "II", u, a), grown("s1", 10, "II", u, a)])
    keep, extra = "role || ':' || text", "(case when cut then 5 else 0 end)"

    def kept(x, initial):
        return f"case when not must and ini = '{initial}' then {grown(x, extra, 'K', keep)} end"

    def reroled(x, role):
        return f"case when not must then {grown(x, f'1 + {extra}', 'R', role + ' || text')} end"

    gone = lambda x: grown(x, 2, "D")
    users = [gone("eu")] + [kept(x, "u") for x in ("a0", "s1", "ea")] + [reroled(x, u) for x in ("a0", "s1", "ea")]
    return f"""
with recursive {CRC_TABLE},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations, crc),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [1, 2] else [1] end) as copy from k where kind <> 0),
f as (select conv_id, turn, role, text, substr(role, 1, 1) as ini, row_number() over w as i, lag(substr(role, 1, 1)) over w as before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said
      from d window w as (partition by conv_id order by turn nulls first, role, text)),
g as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from f),
o as materialized (select *, said = '' or again as must, said <> '' and not again and right(said, 1) not in ('.', '!', '?') as cut from g),
n as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (said = '') as blank, count(*) filter (said <> '' and again) as duplicate,
        count(*) filter (cut) as truncated, count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal, max(i) as n from o group by conv_id),
walk as (
  select conv_id, cast(0 as bigint) as i, {{'c': 0::bigint, 's': '', 'r': ''}}::{kind} as a0, null::{kind} as s1, null::{kind} as au, null::{kind} as aa from n
  union all
  select conv_id, i, {gone("a0")}, list_min([{gone("s1")}, {kept("a0", "s")}]), list_min([{", ".join(users)}]), list_min([{gone("ea")}, {kept("eu", "a")}, {reroled("eu", a)}])
  from (select o.conv_id, o.i, role, text, ini, must, cut, a0, s1, list_min([{to_user}]) as eu, list_min([{to_assistant}]) as ea from walk w join o on o.conv_id is not distinct from w.conv_id and o.i = w.i + 1)),
e as (select n.*, list_min([a0, {to_assistant}]) as best from walk w join n on n.conv_id is not distinct from w.conv_id and n.n = w.i),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.s, '') as audit, sha256(coalesce(substr(best.r, 2), '')) as repaired_sha256
from ids left join e on e.conv_id is not distinct from ids.conv_id
"""


@query("op13_structure_repair", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)
