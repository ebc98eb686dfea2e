"""Declared schemas. Every scalar column is a string; ids are compared as strings."""
from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

CANDIDATE = T.StructType([T.StructField(n, _S) for n in ("candidate_id", "tag", "text", "attrs")])
CANDIDATES = T.ArrayType(CANDIDATE)

INPUT_COLUMNS = ("id", "site_token", "task", "history", "cleaned_html", "candidate_elements")
LABEL_COLUMNS = ("op", "target_id", "value")

TEST = T.StructType([T.StructField(n, _S) for n in INPUT_COLUMNS])
TRAIN = T.StructType([T.StructField(n, _S) for n in INPUT_COLUMNS + LABEL_COLUMNS])
SUBMISSION = T.StructType([T.StructField(n, _S) for n in ("id",) + LABEL_COLUMNS])

OPS = ("CLICK", "TYPE", "SELECT")
