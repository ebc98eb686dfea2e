"""Helpers shared by the operators: code shipping, table access, text rows in Arrow batches."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pickwise.session import tune

ROWS_PER_BATCH = 1000
MAX_CACHE = 300_000
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators; executors get the package, so they need no install of it."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "pickwise_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.join("pickwise", os.path.relpath(full, package)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialized frames that nothing reads any more."""
    for f in frames:
        for path in sorted({p.rsplit("/", 1)[0] for p in f.inputFiles()}):
            to = f.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(to, True)


def free_name(wanted: str, taken) -> str:
    """A column name that clashes with none of the given ones (case-insensitive)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def text_map(df: DataFrame, schema: str, rows: Callable[[str | None], Iterator[tuple] | list[tuple]],
             id_col: str = "doc_id", text_col: str = "text", setup: Callable[[], None] | None = None) -> DataFrame:
    """Run ``rows(text)`` on every text; the result is (id, *tuple) per yielded tuple.

    Whole texts, one Arrow batch at a time; a row of the input may give none or many rows.
    """
    out_schema = f"{id_col} bigint, {schema}"
    struct = T._parse_datatype_string(out_schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(struct)
    kinds = [f.type for f in arrow]

    def run(batches):
        if setup:
            setup()
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in rows(text):
                    out[0].append(key)
                    for c, v in zip(out[1:], r):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], schema=arrow)

    return df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, out_schema)


def fold(id_col: str, parts: int):
    """Remainder of crc32 of the id written as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
