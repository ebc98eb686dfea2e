"""WARC archives of pages: writing with revisits and segments, reading back with segment reassembly.

Writing: of the pages with equal payloads one is a response record, the others are revisit records that refer to it. The
HTTP body of a response is framed in chunks; a block beyond ``segment_bytes`` is cut into a first record and
continuation records, which name the first one as their origin, carry a segment number, and, in the last one, the
total length. Records go through Spark's text sink as raw bytes, each a gzip member of its own; an empty member is the
sink's separator. No file holds more than FILE_RECORDS records, so a file is bounded and read as one row.

Reading: files are parsed record by record by their Content-Length. Unsegmented records are decoded where they are
found. Segments are brought together by their origin, put in order of their numbers, verified against the total length
and then freed of the chunk framing. A page came from one row, so its segments fit a task; only segments are shuffled.
"""
from __future__ import annotations

import base64
import gzip
import io
import uuid
import zlib
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pickwise.llm.common import ROWS_PER_BATCH, prepare
from pickwise.session import materialize, scratch_dir

SEGMENT, CHUNK, FILE_RECORDS = 16 << 10, 4 << 10, 2048  # bytes of a block in one record, of an HTTP chunk; records of a file
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed values of the format
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BATCH_BYTES = 4 << 20


def member(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Payload in HTTP chunk framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[at : at + size] for at in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Payload out of the framing; None if a chunk is cut off or has no sound size line."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        at = end + 2 + size
        if size < 0 or body[at : at + 2] != b"\r\n":
            return None
        parts.append(body[end + 2 : at])
        at += 2
    return None


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def name_of(key: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record/{key}/{segment}')}>"


def records_of(key: int, page_id: int | None, url: str | None, html: str | None, sha: str, first: int, segment_bytes: int) -> list[bytes]:
    """The records of a page; ``first`` is the key of the response that holds its payload."""
    uri = " ".join((url or "").split()) or None  # no line break may enter a header
    fields = [("WARC-Target-URI", uri), ("X-Page-Id", page_id), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if first != key:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name_of(key)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", name_of(first)), *fields], HTTP)]
    block = HTTP + chunked((html or "").encode())
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", name_of(key)), *fields], block)]
    out, last = [], -(-len(block) // segment_bytes)
    for n in range(1, last + 1):
        part = block[(n - 1) * segment_bytes : n * segment_bytes]
        kind = fields if n == 1 else [("WARC-Segment-Origin-ID", name_of(key)), ("WARC-Segment-Total-Length", len(block) if n == last else None)]
        out.append(record([("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", name_of(key, n)), *kind, ("WARC-Segment-Number", n)], part))
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, segment_bytes: int = SEGMENT) -> None:
    """Write the archives of ``pages`` into the folder ``path``.

    Of the rows with equal payloads of at least ``least`` bytes the one with the smallest id is the response and the others
    revisit it, rows that repeat with the same id as well; rows without an id come after all others. Shorter payloads are all
    responses. A null payload counts as empty. Other columns are left out; an empty table writes no record. The table is read
    twice and must give its rows in the same order both times, as files do.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.monotonically_increasing_id())
    raw = F.col("html").cast("binary")
    marked = rows.withColumn("sha", F.sha1(raw)).withColumn("size", F.octet_length("html"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    # equal SHA-1, SHA-256 and length: the payloads are the same
    firsts = marked.where(F.col("size") >= least).groupBy("sha", "size", F.sha2(raw, 256).alias("sha256")).agg(F.min(order).alias("at"), F.count("*").alias("n")).where("n > 1")
    keys = materialize(firsts.select("sha", "size", "sha256", F.col("at.key").alias("first")), "payloads")
    joined = marked.withColumn("sha256", F.sha2(raw, 256)).join(keys, ["sha", "size", "sha256"], "left").select("key", "id", "url", "html", "sha", F.coalesce("first", "key").alias("first"))

    def build(batches):
        for b in batches:
            out, held = [], 0
            for row in zip(*(b.column(i).to_pylist() for i in range(6))):
                for r in records_of(*row, segment_bytes):
                    out.append(member(r))
                    held += len(out[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = joined.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(raw: bytes):
    """(headers with lower-case names, block) of every record of a file, gzip members or plain; (None, None) where it is broken."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    try:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record here")
            head = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            size = int(head["content-length"])
            block = f.read(size)
            if len(block) < size:
                raise ValueError("cut off")
            yield head, block
    except (ValueError, KeyError, EOFError, OSError, zlib.error):
        yield None, None


def number(v: str | None) -> int | None:
    try:
        return int(v) if v is not None else None
    except ValueError:
        return None


PAGE = "record_id string, record_type string, uri string, page_id bigint, refers_to string, digest string, payload_bytes bigint, payload_digest string, payload binary, problem string"
FOUND = PAGE + ", origin string, segment bigint, total bigint, block binary"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T._parse_datatype_string(ddl))


def _judged(kind: str, claimed: str | None, payload: bytes | None, keep: bool, problem: str | None = None) -> tuple:
    """payload_bytes, payload_digest, payload, problem of a record whose block is whole."""
    if kind != "response" or problem:
        return None, None, None, problem
    if payload is None:
        return None, None, None, "framing"
    own = digest(payload)
    return len(payload), own, payload if keep else None, None if claimed in (None, own) else "digest"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response and revisit record of the archives under ``path``.

    (record_id, record_type, uri, page_id, refers_to, digest, payload_bytes, payload_digest, payload, problem): digest is the one
    stated in the header, payload_digest that of the payload found; revisits have no payload of their own. problem is null,
    or 'segments' (a number is missing, repeated or without a first record), 'length', 'framing', 'digest' or 'file' (the rest of
    a file can't be read). Nothing is dropped silently. payloads=False leaves the payloads out.
    """
    prepare(spark)
    found_schema, page_schema = _arrow(FOUND), _arrow(PAGE)

    def find(batches):
        for b in batches:
            for raw in b.column(0):
                out, held = [], 0
                for head, block in parsed(raw.as_py()):
                    if head is None:
                        out.append((None, "broken", None, None, None, None, None, None, None, "file", None, None, None, None))
                        continue
                    kind, segment = head.get("warc-type", ""), number(head.get("warc-segment-number"))
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    claimed = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    name = head.get("warc-record-id")
                    row = (name, kind, head.get("warc-target-uri"), number(head.get("x-page-id")), head.get("warc-refers-to"), claimed)
                    if segment is None:
                        out.append(row + _judged(kind, claimed, payload_of(block) if kind == "response" else None, payloads) + (None, None, None, None))
                    else:
                        origin = head.get("warc-segment-origin-id") if kind == "continuation" else name
                        out.append(row + (None, None, None, None, origin, segment, number(head.get("warc-segment-total-length")), block))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield _emit(out, found_schema)
                        out, held = [], 0
                yield _emit(out, found_schema)

    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a file here
    try:
        found = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(find, FOUND), "warc-records")
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))

    def whole(parts: list[dict]) -> tuple:
        first = next((p for p in parts if p["record_type"] != "continuation"), parts[0])
        row = tuple(first[k] for k in ("record_id", "record_type", "uri", "page_id", "refers_to", "digest"))
        totals = {p["total"] for p in parts} - {None}
        block = b"".join(p["block"] for p in parts)
        if first["record_type"] == "continuation" or [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
            problem = "segments"
        else:
            problem = None if totals == {len(block)} else "length"
        return row + _judged(first["record_type"], first["digest"], None if problem else payload_of(block), payloads, problem)

    def rebuild(batches):
        parts: list[dict] = []
        for b in batches:
            out, held = [], 0
            for p in b.to_pylist():
                if parts and parts[0]["origin"] != p["origin"]:
                    out.append(whole(parts))
                    parts = []
                parts.append(p)
                held += len(p["block"])
                if held > BATCH_BYTES:
                    yield _emit(out, page_schema)
                    out, held = [], 0
            yield _emit(out, page_schema)
        if parts:
            yield _emit([whole(parts)], page_schema)

    pieces = found.where("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment", "record_id")
    return found.where("segment is null").select(*page_schema.names).unionByName(pieces.mapInArrow(rebuild, PAGE))


def resolved(records: DataFrame) -> DataFrame:
    """Per page what the archives say of it: (page_id, payload_bytes, payload_digest, record_type, refers_to, problem).

    A revisit takes size and digest from the response that it refers to (problem 'refers' if there is none or its digest
    is another); refers_to is that response's page id, null for responses.
    """
    rows = materialize(records.drop("payload"), "warc-pages")
    said = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    own = rows.where("record_type != 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "problem")
    again = rows.where("record_type = 'revisit'").join(said, "refers_to", "left")
    problem = F.coalesce("problem", F.when(F.col("d").isNull() | (F.col("d") != F.col("digest")), "refers"))
    return own.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("to").alias("refers_to"), problem.alias("problem")))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row per page; a broken archive is an error."""
    spark = prepare(pages.sparkSession)
    path = f"{scratch_dir(spark)}/pickwise/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:12]}"
    write(pages, path, least=least)
    out = materialize(resolved(read(spark, path, payloads=False)), "warc-resolved")
    bad = out.where("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(f"an archive can't be read back: {bad[0]}")
    return out.drop("problem")
