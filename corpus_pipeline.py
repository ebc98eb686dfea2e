"""Corpus pipeline: language ID, near-dedup, substring dedup, secret scan and packing over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read back as
the next stage's docs. All stages but the last return the columns of documents. A null or empty text goes at the first
stage (it has no language); a text that loses all its words in substring dedup stays as an empty text and packs to
its closing id. Where a stage changes a text, n_chars follows it. An empty table gives an empty result.

A stage's result is to be written before the next stage is called: that one first clears what the stage before has left
in the scratch folder.
"""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from pickwise.llm import langid, nearset, packing, secrets, substring
from pickwise.llm.common import prepare
from pickwise.llm.queries import tokenizer_path
from pickwise.session import clear, materialize, written

_left: list[str] = []  # what the last stage has written on its way


def _stage(fn):
    """A stage under the session's settings; what the stage before has left goes first, but for what is read now."""
    @wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        clear(spark, _left, docs)
        mark = len(written())
        out = fn(spark, docs, sf_dir)
        _left[:] = written(mark)
        return out

    return stage


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now, where the table has such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents whose language is recognised stay."""
    return langid.keep_known(docs, langid.fit(docs))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if a document with a smaller id stays and shares 0.8 of the five-word shingles of both."""
    return nearset.keep_first(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that also stand in an earlier document are cut out."""
    return _with_length(substring.without_repeats(docs))


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    path = "source" if "source" in docs.columns else None
    trees, words = secrets.fit(docs, path_col=path)
    return _with_length(secrets.masked(docs, trees, words, path_col=path))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of ids, one row per piece."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", secret_scan), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read back."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
