"""Scans and sinks for decision tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ranges
from .schema import CANDIDATE, CANDIDATES, TEST, TRAIN


def read_decisions(spark: SparkSession, path: str, labelled: bool = True, fmt: str = "csv", split: bool = False) -> DataFrame:
    """Decision scan with a declared schema; null history/value become ''.

    Quoted newlines survive (``multiLine``) and bytes that are not UTF-8 become U+FFFD. A multi-line scan reads a file in one
    task; with ``split`` a CSV file is read in byte ranges (see `ranges`).
    """
    schema = TRAIN if labelled else TEST
    if fmt == "csv" and split:
        return fill_text(ranges.read_csv(spark, path, schema))
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = (reader.option("header", True).option("multiLine", True)
                  .option("escape", '"').option("mode", "PERMISSIVE"))
    return fill_text(reader.format(fmt).load(path))


def read_decisions_stream(spark: SparkSession, path: str, labelled: bool = False,
                          files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """The same scan in bounded batches: each trigger takes at most n new files."""
    reader = spark.readStream.schema(TRAIN if labelled else TEST).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return fill_text(reader.format(fmt).load(path))


def fill_text(df: DataFrame) -> DataFrame:
    """Null text columns to the empty string."""
    return df.fillna("", subset=[c for c in ("history", "value") if c in df.columns])


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where every listed column is present."""
    return df.dropna(subset=list(cols))


def with_id(df: DataFrame) -> DataFrame:
    """The first column takes the name ``id`` when no column has it."""
    return df if "id" in df.columns else df.withColumnRenamed(df.columns[0], "id")


def parse_candidates(df: DataFrame, source: str = "candidate_elements", out: str = "cands") -> DataFrame:
    """JSON text to an array of candidates; malformed text gives an empty array."""
    parsed = F.coalesce(F.from_json(source, CANDIDATES), F.expr(f"cast(array() as {CANDIDATES.simpleString()})"))
    return df.withColumn(out, parsed)


def parse_candidates_open(df: DataFrame, source: str = "candidate_elements", out: str = "cands") -> tuple[DataFrame, DataFrame]:
    """(rows with candidates, rejects): the known keys of a candidate are typed, all others are kept.

    The text is parsed once to a VARIANT. A candidate has the declared fields and `more`, a map of its other keys in JSON form
    (strings bare). A text that is no array gives no candidates, and its row is also among the rejects (all columns, and
    `reason`: 'malformed' or 'no array'); elements that are no objects are left out. A missing or null field is null.
    """
    v, known = F.col("_v"), [f.name for f in CANDIDATE]
    d = df.withColumn("_v", F.try_parse_json(source))
    kind = F.schema_of_variant("_v")
    reason = F.when(v.isNull(), "malformed").when(~kind.startswith("ARRAY"), "no array")
    rejects = d.withColumn("reason", F.when(F.col(source).isNotNull(), reason)).filter("reason is not null").drop("_v")
    whole = F.coalesce(F.expr("try_cast(_v as array<variant>)"), F.expr("cast(array() as array<variant>)"))
    objects = F.filter(F.transform(whole, lambda x: F.struct(x.alias("x"), F.schema_of_variant(x).startswith("OBJECT").alias("is"))), lambda s: s["is"])

    def one(s):
        fields = F.map_from_entries(F.filter(F.map_entries(F.try_variant_get(s["x"], "$", "map<string,variant>")), lambda e: ~e["key"].isin(*known)))
        return F.struct(*[F.try_variant_get(s["x"], f"$.{n}", "string").alias(n) for n in known], F.transform_values(fields, lambda _, x: F.try_variant_get(x, "$", "string")).alias("more"))

    return d.withColumn(out, F.transform(objects, one)).drop("_v"), rejects


def with_extra_keys(df: DataFrame, cands: str = "cands") -> DataFrame:
    """Candidates whose other keys stand behind their attributes, in the order of the keys, as `key=value`."""
    def one(c):
        extra = F.transform(F.array_sort(F.map_entries(c["more"])), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
        attrs = F.array_join(F.filter(F.concat(F.array(F.coalesce(c["attrs"], F.lit(""))), extra), lambda a: a != ""), " | ")
        return F.struct(c["candidate_id"].alias("candidate_id"), c["tag"].alias("tag"), c["text"].alias("text"), attrs.alias("attrs"))

    return df.withColumn(cands, F.transform(cands, one))


def write_submission(df: DataFrame, path: str) -> None:
    """Submission CSV with every text field quoted."""
    (df.select("id", "op", "target_id", "value").write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path))


def write_corpus(df: DataFrame, path: str, fmt: str = "json", by: str | None = "html_type") -> None:
    """Corpus records as JSON lines or parquet, one folder per page kind."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).format(fmt).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric table as JSON lines."""
    df.write.mode("overwrite").json(path)
