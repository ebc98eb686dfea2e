"""Decision tables derived from the order tables, for the registered queries.

One order is one decision and its lines are the candidates. The frames are written once per
session to the shared scratch folder, as a decision table would lie at rest, and every query then
scans only the columns it needs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize, pin, tune

SLICE, SLICES = 3_000_000, 4  # lines that are shuffled at once, while there are no more slices than that

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# The derivation shared by Spark and DuckDB. {list} is the ordered string aggregate.
CANDIDATES_SQL = """
select id, cand_pos, concat('c_', id, '_', cand_pos) as candidate_id, tag, text, label, name, opts,
  concat('name=', name, ' | label=', label, case when opts = '' then '' else concat(' | options=', opts) end) as attrs
from (
  select l_orderkey as id,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as cand_pos,
    case l_partkey % 6 when 0 then 'input' when 1 then 'select' when 2 then 'button' when 3 then 'a' when 4 then 'textarea' else 'div' end as tag,
    case when l_partkey % 7 = 0 then '' else p_name end as text,
    concat(p_type, ' ', replace(p_brand, '#', ' ')) as label,
    replace(p_name, ' ', '_') as name,
    case when l_partkey % 6 = 1 then concat(p_type, ' / ', p_name, ' / none') else '' end as opts
  from lineitem join part on l_partkey = p_partkey) x
"""

DECISIONS_SQL = """
with c as (
  select cd.*, case when tag in ('input','textarea') then 'TYPE' when tag = 'select' then 'SELECT' else 'CLICK' end as op,
    case when tag = 'select' then replace(name, '_', ' ') when tag in ('input','textarea') then concat('v', id % 100) else '' end as val,
    count(*) over (partition by id) as n_cands
  from candidates cd),
h as (select id, {steps} as history, {done} as done from c where cand_pos < id % n_cands group by id),
t as (select * from c where cand_pos = id % n_cands)
select o_orderkey as id, n_name as site_token,
  concat('Set the ', t.label, ' ', t.text, ' to "', t.val, '" by ', cast(cast(o_orderdate as date) as varchar(10))) as task,
  coalesce(h.history, '') as history,
  case when o_orderkey % 3 = 0
    then concat('<h1>', t.label, '</h1><section class="s" aria-label="current workflow panel"><input name="', t.name, '"></section><aside class="workflow-context">current step ', t.cand_pos + 1, ' of ', t.n_cands, '</aside><div class="completed-fields">Completed: ', coalesce(h.done, ''), '</div>')
    else pg.html end as cleaned_html,
  t.op as op, t.candidate_id as target_id, t.val as value, t.cand_pos as target_pos, t.n_cands as n_cands
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
join t on t.id = o_orderkey left join h on h.id = o_orderkey
left join pages pg on pg.page_id = o_orderkey % (select count(*) from pages)
"""

STEP_TEXT = ("concat('Step ', cand_pos + 1, ': [', tag, '] ', text, ' -> ', op, "
             "case when op = 'CLICK' then '' else concat(': ', val) end)")

RESPONSES_SQL = """
select id, case
   when id % 11 = 0 then '<think>unsure {x}</think> no answer'
   when id % 13 = 0 then concat('<think>{"op":"CLICK"}</think>{"op": "', op, '", "choice": 99, "value": "', value, '"}')
   when id % 17 = 0 then concat('{"op": "hover", "choice": ', target_pos + 1, ', "value": ""}')
   when id % 5 = 0 then concat('<think>a</think>{"op": "', lower(op), '", "choice": ', 1 + (target_pos + 1) % n_cands, ', "value": "', value, '"}')
   else concat('<think>{"choice": 1}</think>', '{"op": "', op, '", "choice": ', target_pos + 1, ', "value": "', value, '"}') end as response
from decisions
"""

VOTES_SQL = """
select id, f.fold as fold, case when (id + f.fold) % 4 = 0 then 'CLICK' else op end as op,
  case when (id + 2 * f.fold) % 5 = 0 then concat('c_', id, '_0') else target_id end as target_id,
  case when (id + f.fold) % 4 = 0 then '' else value end as value
from decisions cross join (values (0),(1),(2)) f(fold)
"""

# The Spark form of the two, over one row per order. Lines become candidates in two steps.
LIST_STEPS = (
    """struct(i as cand_pos, x.l_partkey % 6 = 1 as picks, x.p_type as p_type, x.p_name as p_name,
      case x.l_partkey % 6 when 0 then 'input' when 1 then 'select' when 2 then 'button' when 3 then 'a' when 4 then 'textarea' else 'div' end as tag,
      case when x.l_partkey % 7 = 0 then '' else x.p_name end as text,
      concat(x.p_type, ' ', replace(x.p_brand, '#', ' ')) as label, replace(x.p_name, ' ', '_') as name)""",
    """struct(x.cand_pos, x.tag, x.text, x.label, x.name,
      concat('name=', x.name, ' | label=', x.label, case when x.picks then concat(' | options=', x.p_type, ' / ', x.p_name, ' / none') else '' end) as attrs,
      case when x.tag in ('input','textarea') then 'TYPE' when x.tag = 'select' then 'SELECT' else 'CLICK' end as op,
      case when x.tag = 'select' then replace(x.name, '_', ' ') when x.tag in ('input','textarea') then concat('v', id % 100) else '' end as val)""",
)

_STEP = ("concat('Step ', x.cand_pos + 1, ': [', x.tag, '] ', x.text, ' -> ', x.op, "
         "case when x.op = 'CLICK' then '' else concat(': ', x.val) end)")

ROW = {
    "task": "concat('Set the ', t.label, ' ', t.text, ' to \"', t.val, '\" by ', cast(cast(o_orderdate as date) as varchar(10)))",
    "history": f"array_join(transform(h, x -> {_STEP}), ' | ')",
    "workflow": """case when id % 3 = 0
    then concat('<h1>', t.label, '</h1><section class="s" aria-label="current workflow panel"><input name="', t.name, '"></section><aside class="workflow-context">current step ', t.cand_pos + 1, ' of ', n_cands, '</aside><div class="completed-fields">Completed: ', array_join(h.name, ', '), '</div>') end""",
    "op": "t.op", "target_id": "concat('c_', id, '_', t.cand_pos)", "value": "t.val", "target_pos": "t.cand_pos", "n_cands": "n_cands",
}


def _decisions_sql() -> str:
    agg = "string_agg({}, '{}' order by cand_pos)"
    return DECISIONS_SQL.format(steps=agg.format(STEP_TEXT, " | "), done=agg.format("name", ", "))


def duck_ctes(*names: str) -> str:
    """`with …` prefix for a DuckDB oracle, holding the named views and what they need."""
    body = {"candidates": CANDIDATES_SQL, "decisions": _decisions_sql(),
            "responses": RESPONSES_SQL, "votes": VOTES_SQL}
    need = {"candidates"} | set(names)
    if need & {"responses", "votes"}:
        need.add("decisions")
    return "with " + ",\n".join(f"{n} as materialized ({body[n].strip()})" for n in body if n in need)


class Fixture:
    """Frames of one data folder; staged ones are written on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._staged: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _lines(self, mine: Column) -> DataFrame:
        """(id, x) of the orders in ``mine`` (of id): a line with its part, as narrow as CANDIDATES_SQL lets it be: it is the widest row that is shuffled.

        Lines of one number and part key are the same candidate, and what orders them further only tells apart
        rows of a key that repeats in part: it travels where one does.
        """
        part = self.table("part").select("p_partkey", "p_name", "p_type", "p_brand")
        repeats = part.filter("p_partkey is not null").groupBy("p_partkey").count().agg(F.max("count") > 1).scalar()
        lines = self.table("lineitem").withColumn("id", F.col("l_orderkey")).filter("id is not null").filter(mine)
        lines = lines.select("id", "l_linenumber", "l_partkey", F.when(repeats, F.struct("l_suppkey", "l_extendedprice", "l_shipdate")).alias("tie"))
        return (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
                .select("id", F.struct("l_linenumber", "l_partkey", "tie", "p_name", "p_type", "p_brand").alias("x")))

    def _lists(self, mine: Column) -> DataFrame:
        """(id, cs): the candidates of an order in one row, as CANDIDATES_SQL has them, with their op and value.

        Lines meet their part and are shuffled once, by order; the texts are made behind that shuffle.
        """
        rows = self._lines(mine).repartition("id").groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        for made in LIST_STEPS:
            rows = pin(rows.withColumn("xs", F.expr(f"transform(xs, (x, i) -> {made})")), "xs")
        return rows.withColumnRenamed("xs", "cs")

    def _copies(self) -> DataFrame:
        """(page_id, copy): numbers of the rows of page ids that repeat. Written, so that the plan knows how few they are and leaves the orders where they lie."""
        pages = self.table("pages").filter("page_id is not null").groupBy("page_id").count().filter("count > 1")
        return materialize(pages.select("page_id", F.explode(F.sequence(F.lit(1), "count")).alias("copy")), "page-copies")

    def _derive(self, copies: DataFrame, mine: Column) -> DataFrame:
        """One narrow row per decision of DECISIONS_SQL whose id is in ``mine``: its page is only named, by `page_id` and `copy`."""
        orders, pages = self.table("orders").withColumn("id", F.col("o_orderkey")).filter(mine), self.table("pages").select("page_id")
        orders = (orders.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                  .select("id", F.col("n_name").alias("site_token"), "o_orderdate", (F.col("id") % pages.agg(F.count("*")).scalar()).alias("page_id"))
                  .join(copies, "page_id", "left").withColumn("copy", F.coalesce("copy", F.lit(1).cast("long"))))
        lists = (self._lists(mine).withColumn("n_cands", F.size("cs").cast("long")).withColumn("at", F.expr("cast(id % n_cands as int)"))
                 .filter("at >= 0").withColumn("t", F.expr("cs[at]")))
        lists = pin(lists.withColumn("h", F.expr("slice(cs, 1, at)")), "t", "h")
        rows = orders.join(lists, "id")
        return rows.selectExpr("id", "site_token", *[f"{v} as {k}" for k, v in ROW.items()], "page_id", "copy",
                               "transform(cs, x -> struct(x.tag, x.text, x.attrs)) as listed")

    def _made(self) -> list[DataFrame]:
        """The decisions by slices of the orders, for the disk: shuffle files of one slice are gone before the next one's are written."""
        n, copies = min(SLICES, 1 + self.table("lineitem").count() // SLICE), self._copies()
        return [self._derive(copies, F.pmod(F.xxhash64("id"), F.lit(n)) == j) for j in range(n)]

    def _pages(self) -> DataFrame:
        """(page_id, copy, page_html): the pages by id, rows of one id numbered. An aggregate, so that a left join that nobody
        takes a column from is dropped by the optimizer."""
        number = F.row_number().over(Window.partitionBy("page_id").orderBy("html")).cast("long")  # of the type of `copy`, or the join stays
        return (self.table("pages").filter("page_id is not null").select("page_id", "html").withColumn("copy", number)
                .groupBy("page_id", "copy").agg(F.min("html").alias("page_html")))

    @property
    def decisions(self) -> DataFrame:
        """One row per decision, candidates both as JSON text and as an array.

        At rest a row names its page; the page's text joins it only for those who select `cleaned_html`, and is never written again.
        """
        if "decisions" not in self._staged:
            parts = self._made()
            self._staged["decisions"] = materialize(parts[0], "decisions", *parts[1:], compression="zstd")
        d = self._staged["decisions"].join(self._pages(), ["page_id", "copy"], "left")
        d = d.withColumn("cands", F.expr("transform(listed, (x, i) -> struct(concat('c_', id, '_', i) as candidate_id, x.tag, x.text, x.attrs))"))
        return d.select("id", "site_token", "task", "history", F.expr("case when id % 3 = 0 then workflow else page_html end").alias("cleaned_html"), "op", "target_id",
                        "value", "target_pos", "n_cands", "cands", F.to_json("cands").alias("candidate_elements"))

    @property
    def responses(self) -> DataFrame:
        d = self.decisions.select("id", "op", "value", "target_pos", "n_cands")
        return self.spark.sql(RESPONSES_SQL.replace("{", "{{").replace("}", "}}").replace("from decisions", "from {d}"), d=d)

    @property
    def votes(self) -> DataFrame:
        d = self.decisions.select("id", "op", "target_id", "value", F.explode(F.array(*map(F.lit, range(3)))).alias("fold"))
        sel = VOTES_SQL.replace("f.fold", "fold").replace("from decisions cross join (values (0),(1),(2)) f(fold)", "from {d}")
        return self.spark.sql(sel, d=d)


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _FIXTURES:
        tune(spark)
        _FIXTURES[key] = Fixture(spark, key[1])
    return _FIXTURES[key]
