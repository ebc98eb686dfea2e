"""CSV scans whose tasks follow the size of the files, also where quoted fields hold line breaks.

A file is read in the byte ranges of Spark's text scan. Whether a range starts inside quotes follows from the quotes
before it: every range reports the parity of its quotes, and a running sum over the ranges of a file says it for
all of them. So each range takes its records from its first true record end on. What a range can't finish by itself
(the begin of a record that goes on in the next one, and its end there) is stitched apart. Records are then parsed
by Spark's own CSV parser, in the row.

Quotes inside a field are doubled and the field is quoted, as in RFC 4180; a stray quote in an unquoted field would shift
the parity. Lines end with \\n or \\r\\n. The first record of every file is its header.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import materialize, stack

WHOLE, BEGIN, END, INSIDE = range(4)  # pieces: a record, its begin, its end, a range that lies inside one
OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
PIECE = "rng bigint, seq bigint, piece int, header boolean, record binary"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order inside each range: (rng, file, start, value); rng names the range."""
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.option("lineSep", "\n").text(path).select(F.xxhash64(file, start).alias("rng"), file.alias("file"), start.alias("start"), "value")


def range_parity(rows: DataFrame) -> DataFrame:
    """(rng, file, start, inside, open): whether a range starts inside quotes, and whether it ends there."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    per = rows.groupBy("rng", "file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    line = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("odd").over(line)  # a file has size / maxPartitionBytes ranges
    return per.select("rng", "file", "start", ((total - F.col("odd")) % 2 == 1).alias("inside"), (total % 2 == 1).alias("open"))


def _cut(known, inside, wanted):
    """Pieces of the wanted kinds out of Arrow batches of (rng, start, value)."""
    def run(batches):
        rng, seq, held, within, goes_on, header, out = None, 0, [], False, False, False, []

        def emit(piece):
            nonlocal held, seq, header
            if piece in wanted:
                out.append((rng, seq, piece, header, b"\n".join(held)))
            held, seq, header = [], seq + 1, False

        def flush():
            if held:
                emit(INSIDE if goes_on else BEGIN)

        def batch():
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["rng", "seq", "piece", "header", "record"])
            out.clear()
            return made

        for b in batches:
            for r, start, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if r != rng:
                    flush()
                    at = int(np.searchsorted(known, r))
                    if at == len(known) or known[at] != r:
                        raise RuntimeError("files or the size of their ranges changed since the quotes were counted")
                    rng, seq, within, header = r, 0, bool(inside[at]), start == 0
                    goes_on = within
                held.append(line)
                within ^= bool(line.count(b'"') & 1)
                if not within:
                    emit(END if goes_on else WHOLE)
                    goes_on = False
            yield batch()
        flush()
        yield batch()

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every record of the CSV files under ``path``, without headers and empty lines."""
    rows = lines(spark, path)
    ranges = materialize(range_parity(rows), "csv-ranges")
    # one number and one bit for each range of maxPartitionBytes: 7 MB for 100 TB
    got = ranges.select("rng", "inside", "open").toArrow().sort_by("rng")
    known, inside = got.column("rng").to_numpy(), got.column("inside").to_numpy(zero_copy_only=False)
    if len(np.unique(known)) < len(known):
        raise RuntimeError("two ranges have one name")
    shared = spark.sparkContext.broadcast((known, inside))
    plain = rows.select("rng", "start", F.col("value").cast("binary").alias("value"))

    def pieces(*wanted):
        return plain.mapInArrow(lambda b: _cut(*shared.value, wanted)(b), PIECE)

    text = F.col("record").cast("string")  # bytes that are no UTF-8 become U+FFFD in the parser
    whole = pieces(WHOLE).where("not header").select(text.alias("record"))
    if any(got.column("open").to_pylist()):  # some record crosses a border, or a file ends inside quotes
        parts = materialize(pieces(BEGIN, END, INSIDE), "csv-borders").join(ranges.select("rng", "file", "start"), "rng")
        line = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("nth", F.sum((F.col("piece") == BEGIN).cast("long")).over(line))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", text.alias("record")))), lambda p: p["record"]), "\n")
        crossing = parts.groupBy("file", "nth").agg(joined.alias("record"), F.max("header").alias("header")).where("not header").select("record")
        whole = stack(whole, crossing)
    # where \r\n ends the lines it stands for one line break inside fields too, as in the multi-line scan
    cut = F.replace(F.expr("substr(record, 1, length(record) - 1)"), F.lit("\r\n"), F.lit("\n"))
    bare = F.when(F.endswith("record", F.lit("\r")), cut).otherwise(F.col("record"))
    return whole.select(bare.alias("record")).where("record <> ''")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of CSV files with headers, read in ranges; like a multi-line scan, with tasks that follow the size."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records(spark, path).select(F.from_csv("record", ddl, OPTIONS).alias("r")).select("r.*")
