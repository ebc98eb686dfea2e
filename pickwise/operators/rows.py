"""Row-level projections, filters and key joins on decision frames."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parse import html_type
from ..functions.text import md5_key, strip, text
from ..sources.schema import OPS

KEEP = ("id", "site_token", "task", "history", "op", "target_id", "value")


def explode_candidates(df: DataFrame, with_label: bool = True, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per decision and candidate: position, candidate count and, if asked, the label flag."""
    cols = [F.col(c) for c in keep]
    extra = [F.col("target_id").alias("_target")] if with_label else []
    out = (df.select(*cols, *extra, F.size("cands").alias("n_cands"), F.posexplode("cands").alias("cand_pos", "_c"))
           .select(*keep, "n_cands", "cand_pos", "_c.candidate_id", "_c.tag",
                   text("_c.text").alias("text"), text("_c.attrs").alias("attrs"), *(["_target"] if with_label else [])))
    if not with_label:
        return out
    return out.withColumn("is_target", (F.col("candidate_id") == F.col("_target")).cast("int")).drop("_target")


def exclude_sites(df: DataFrame, sites: Iterable[str] | DataFrame) -> DataFrame:
    """Drop decisions of the listed sites (a list, or a table joined as an anti join)."""
    if isinstance(sites, DataFrame):
        return df.join(sites.select("site_token").distinct(), "site_token", "left_anti")
    return df.filter(~F.col("site_token").isin(list(sites)))


def with_html_type(df: DataFrame) -> DataFrame:
    return df.withColumn("html_type", html_type("cleaned_html"))


def with_site_seen(df: DataFrame, train: DataFrame) -> DataFrame:
    """Flag rows whose site occurs in the training frame."""
    seen = train.select("site_token").distinct().withColumn("_seen", F.lit(True))
    return (df.join(seen, "site_token", "left")
            .withColumn("site_seen", F.col("_seen").isNotNull()).drop("_seen"))


def filter_ops(df: DataFrame, ops: Iterable[str] = ("TYPE", "SELECT")) -> DataFrame:
    return df.filter(F.col("op").isin(list(ops)))


def value_in_task() -> Column:
    v = strip(F.lower(text("value")))
    return F.when(text("value") == "", False).otherwise(F.lower(text("task")).contains(v))


def empty_candidate(c: Column) -> Column:
    return (strip(text(c["text"])) == "") & (strip(text(c["attrs"])) == "")


def clean_submission(df: DataFrame) -> DataFrame:
    """Valid op, one-line trimmed value, no value for CLICK, no nulls."""
    op = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise("CLICK")
    value = strip(F.regexp_replace(text("value"), r"[\n\r]", " "))
    return df.select("id", op.alias("op"), text("target_id").alias("target_id"),
                     F.when(op == "CLICK", "").otherwise(value).alias("value"))


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Reproducible sample of n rows: the n smallest keyed hashes."""
    return df.orderBy(md5_key(seed, "id"), "id").limit(n)


def align_to_ids(ids: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per requested id; ids without a prediction get the default answer."""
    return ids.select("id").join(preds, "id", "left").select(
        "id", F.coalesce("op", F.lit("CLICK")).alias("op"), text("target_id").alias("target_id"), text("value").alias("value"))


def join_test(sub: DataFrame, test: DataFrame) -> DataFrame:
    return sub.join(test, "id")


def attach_row(cand: DataFrame, rows: DataFrame) -> DataFrame:
    """Row-level columns onto the candidate rows of the same decision."""
    return cand.join(rows, "id")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default, out: str | None = None) -> DataFrame:
    """Value of a keyed table with a default. No broadcast hint: adaptive execution measures the table."""
    d = dim.select(F.col(key), F.col(value).alias("_v"))
    return df.join(d, key, "left").withColumn(out or value, F.coalesce("_v", F.lit(default))).drop("_v")


def mapped(c: Column, pairs: dict[str, str], default: str) -> Column:
    """Small fixed map as a column expression."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c], F.lit(default))


def candidate_of(id_col: str | Column, cands: str | Column = "cands") -> Column:
    """First candidate of the row with this id (null if absent); stays inside the row, no join."""
    want = F.col(id_col) if isinstance(id_col, str) else id_col
    arr = F.col(cands) if isinstance(cands, str) else cands
    return F.try_element_at(F.filter(arr, lambda c: c["candidate_id"] == want), F.lit(1))


def with_target_present(df: DataFrame) -> DataFrame:
    return df.withColumn("target_present", F.exists("cands", lambda c: c["candidate_id"] == F.col("target_id")))
