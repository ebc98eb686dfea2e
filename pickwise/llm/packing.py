"""Packing by power-of-two decomposition.

A document of n ids (its text and a closing id 0) is cut into pieces of 1024 and the binary digits of the
rest, longest first. Every piece is a sequence of its own whose length is a power of two: no sequence crosses
documents and none is padded. Pieces of one length form a bucket, which is how batches are cut.
"""
from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

from pickwise.llm.bpe import coder
from pickwise.llm.common import text_map

LIMIT, CLOSING = 1024, b"\x00\x00\x00\x00"


def binary_pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; lengths are powers of two up to the limit."""
    out, at = [], 0
    while n - at >= limit:
        out.append((at, limit))
        at += limit
    while n > at:
        size = 1 << ((n - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    Null or empty text gives the closing id alone. Repeated rows are packed each on its own; other columns
    are left out. ``sequence_id`` is unique over the result. No shuffle: a piece is a whole sequence.
    """
    if limit & (limit - 1):
        raise ValueError("the limit must be a power of two")

    def rows(text):
        ids = coder("byte", path).encode(text) + CLOSING
        n = len(ids) // 4
        for start, length in binary_pieces(n, limit):
            piece = ids[4 * start : 4 * (start + length)]
            yield (start, length, zlib.crc32(piece), n) + ((piece,) if with_ids else ())

    schema = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else "")
    out = text_map(docs, schema, rows, id_col, text_col)
    return out.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences by length, so every file holds sequences of one shape."""
    packed.write.partitionBy("bucket").parquet(path)
