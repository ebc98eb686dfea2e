"""Archives of pages: round trip, revisits, segments, and archives that are broken."""
import gzip

import pytest

from pickwise.llm import warc
from pickwise.llm.common import prepare

SCHEMA = "page_id bigint, url string, html string, `key` int, sha string, size int, first string"
EXTRA = (1, "s", 2, "f")


def pages():
    long = "<p>é中😀 " * 9000
    nasty = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"
    texts = [None, "", "<a>", long, "<a>", nasty, nasty * 700, long, "x" * warc.SEGMENT, "\x00\x1f\x8b", ""]
    rows = [(i * 3 - 4, f"http://h/{i}\r\nX: y" if i % 4 else None, t) for i, t in enumerate(texts)]
    return rows + [(rows[3][0], "again", long), (None, "u", "<a>"), (None, "u", "only here"), (2**63 - 1, "u", "<a>")]


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def saved(spark, rows, path, **kw):
    """Written from a table at rest, as rows are read twice."""
    frame(spark, rows).write.parquet(f"{path}-pages")
    warc.write(spark.read.parquet(f"{path}-pages"), f"{path}-warc", **kw)
    return f"{path}-warc"


@pytest.mark.parametrize("segment", [warc.SEGMENT, 100])
def test_round_trip(spark, tmp_path, segment):
    rows = pages()
    path = saved(spark, rows, str(tmp_path / "a"), segment_bytes=segment)
    got = warc.read(spark, path).collect()
    assert all(r["problem"] is None for r in got) and len(got) == len(rows)
    whole = {(i, t or "") for i, _, t in rows}
    kept = {(r["page_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response"}
    assert kept <= whole and {t for _, t in kept} == {t for _, t in whole}
    assert all(r["payload_digest"] == warc.digest(bytes(r["payload"])) for r in got if r["record_type"] == "response")
    report = {}
    for r in warc.resolved(warc.read(spark, path, payloads=False)).collect():
        report.setdefault(r["page_id"], []).append(tuple(r)[1:])
    smallest = {}
    for i, _, t in rows:
        smallest[t or ""] = min([x for x in (smallest.get(t or ""), i) if x is not None], default=None)
    for i, _, t in rows:
        if i is not None and [r[0] for r in rows].count(i) == 1:
            raw = (t or "").encode()
            first = smallest[t or ""]
            assert report[i] == [(len(raw), warc.digest(raw), "response" if first == i else "revisit", None if first == i else first, None)]
    repeated = rows[3][0]  # the row that repeats revisits its twin
    assert sorted(r[2:4] for r in report[repeated]) == [("response", None), ("revisit", repeated)] if smallest[rows[3][2]] == repeated else True


def test_least_size(spark, tmp_path):
    rows = [(i, "u", t) for i, t in enumerate(["ab", "ab", "abc", "abc"])]
    got = warc.resolved(warc.read(spark, saved(spark, rows, str(tmp_path / "a"), least=3))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2)]


def test_empty(spark, tmp_path):
    none = frame(spark, pages()).limit(0)
    assert warc.archive(none).count() == 0


def test_files_are_standard_gzip(spark, tmp_path):
    path = saved(spark, pages(), str(tmp_path / "a"))
    raw = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "a-warc").glob("part-*")))
    assert raw.count(b"WARC-Type: response") + raw.count(b"WARC-Type: revisit") == len(pages())
    assert b"WARC-Segment-Number: 2\r\n" in raw and b"WARC-Segment-Total-Length: " in raw


def plain(name, **fields):
    block = fields.pop("block", b"HTTP/1.1 200 OK\r\n\r\nbody")
    return warc.record([("WARC-Type", fields.pop("kind", "response")), ("WARC-Record-ID", name), *((k.replace("_", "-"), v) for k, v in fields.items())], block)


def test_broken_archives_are_told(spark, tmp_path):
    """Every fault gives a row with its name; sound records beside it are read."""
    def part(n, origin, block, total=None, kind="continuation"):
        return plain(f"<{origin}-{n}>" if n > 1 else f"<{origin}>", kind=kind if n > 1 else "response", WARC_Segment_Origin_ID=f"<{origin}>" if n > 1 else None, WARC_Segment_Number=n, WARC_Segment_Total_Length=total, block=block)

    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"
    files = [
        plain("<sound>", X_Page_Id=1) + plain("<info>", kind="warcinfo", block=b"software: x\r\n"),
        part(3, "ok", b"\n\r\n", len(head) + 13) + part(2, "ok", b"abc\r\n0\r") + part(1, "ok", head + b"3\r\n"),  # in any order
        part(1, "gap", head) + part(3, "gap", b"0\r\n\r\n", len(head) + 5),
        part(1, "short", head) + part(2, "short", b"0\r\n\r\n", 999),
        part(1, "endless", head) + part(2, "endless", b"0\r\n\r\n"),
        part(2, "orphan", b"0\r\n\r\n", 5),
        plain("<cut-chunk>", block=head + b"ff\r\nabc\r\n0\r\n\r\n"),
        plain("<no-size>", block=head + b"zz\r\nabc\r\n0\r\n\r\n"),
        plain("<digest>", WARC_Payload_Digest="sha1:AAAA"),
        plain("<revisit>", kind="revisit", WARC_Refers_To="<nowhere>", X_Page_Id=7),
        b"no archive\r\n",
        plain("<before-cut>", X_Page_Id=9) + plain("<x>")[:-9],
    ]
    for i, raw in enumerate(files):
        (tmp_path / f"{i}.warc").write_bytes(raw if i % 2 else gzip.compress(raw))
    prepare(spark)
    got = warc.read(spark, str(tmp_path))
    said = {r["record_id"]: r["problem"] for r in got.collect() if r["record_id"]}
    assert {k: v for k, v in said.items() if v is None} == {"<sound>": None, "<ok>": None, "<revisit>": None, "<before-cut>": None}
    assert said["<gap>"] == "segments" and said["<orphan-2>"] == "segments" and said["<endless>"] == "segments" and said["<short>"] == "length"
    assert said["<cut-chunk>"] == "framing" and said["<no-size>"] == "framing" and said["<digest>"] == "digest"
    assert sum(r["problem"] == "file" for r in got.collect()) == 2
    assert {bytes(r["payload"]) for r in got.where("record_id = '<ok>'").collect()} == {b"abc"}
    assert [r["problem"] for r in warc.resolved(got).where("page_id = 7").collect()] == ["refers"]


def test_chunk_framing():
    for n in (0, 1, warc.CHUNK, warc.CHUNK + 1, 3 * warc.CHUNK):
        assert warc.unchunked(warc.chunked(b"\r" * n)) == b"\r" * n
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    assert warc.unchunked(b"-1\r\n\r\n") is None and warc.unchunked(b"") is None
