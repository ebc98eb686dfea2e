"""CSV files read in byte ranges against Spark's own multi-line scan."""
import csv
import random

import pytest

from pickwise.sources import io, ranges
from pickwise.sources.schema import TRAIN

SIZE, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in (SIZE, COST)}

    def use(n):
        spark.conf.set(SIZE, str(n))
        spark.conf.set(COST, "0")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL, last=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8", errors="surrogateescape") as f:
        w = csv.writer(f, lineterminator=end, quoting=quoting)
        w.writerow([c.name for c in TRAIN])
        w.writerows(rows)
    if not last:
        raw = path.read_bytes()
        path.write_bytes(raw[: -len(end)])


def some_rows(seed, n=300):
    rng = random.Random(seed)
    texts = ["plain", "", "two\nlines", 'a "quoted" word', '"', '""\n""', "comma, here", "\n", "é中", " padded ", "x" * 300, "line\r\nbreak", "\n\n\n", '",\n"', "bad \udcff\udce9 bytes"]
    return [[f"r{i}", *[rng.choice(texts) for _ in range(len(TRAIN) - 1)]] for i in range(n)]


def both(spark, path):
    key = lambda r: tuple(str(v) for v in r)
    a = sorted(map(tuple, io.read_decisions(spark, str(path), split=True).collect()), key=key)
    b = sorted(map(tuple, io.read_decisions(spark, str(path)).collect()), key=key)
    return a, b


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
@pytest.mark.parametrize("end,quoting,last", [("\n", csv.QUOTE_MINIMAL, True), ("\r\n", csv.QUOTE_ALL, True), ("\n", csv.QUOTE_ALL, False)])
def test_equal_to_the_multi_line_scan(spark, tmp_path, small_ranges, size, end, quoting, last):
    if size == 64 and end == "\r\n":
        pytest.skip("one file of many ranges is enough here")
    rows = some_rows(size, 60 if size == 64 else 300)
    write(tmp_path / "in" / "a.csv", rows[: len(rows) // 2], end, quoting, last)
    write(tmp_path / "in" / "b.csv", rows[len(rows) // 2 :], end, quoting, last)
    small_ranges(size)
    a, b = both(spark, tmp_path / "in")
    assert a == b and len(a) == len(rows)
    assert any("�" in str(v) for r in a for v in r)


def test_tasks_follow_the_size(spark, tmp_path, small_ranges):
    write(tmp_path / "in" / "a.csv", some_rows(1))
    small_ranges(2000)
    size = (tmp_path / "in" / "a.csv").stat().st_size
    assert ranges.lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() >= size // 2000


def test_edges(spark, tmp_path, small_ranges):
    small_ranges(128)
    long = [["big", "s", "line\n" * 400, "", "", "", "", "", ""], ["after", "s", "t", "", "", "", "", "", ""]]  # a field that fills many ranges
    write(tmp_path / "long" / "a.csv", long)
    a, b = both(spark, tmp_path / "long")
    assert a == b and len(a) == 2 and max(len(r[2]) for r in a) == 2000
    write(tmp_path / "none" / "a.csv", [])
    a, b = both(spark, tmp_path / "none")
    assert a == b == []
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "a.csv").write_text("id,site_token\n\n\nx,y\n\nz\n")  # empty lines, short rows
    a, b = both(spark, tmp_path / "blank")
    assert a == b and len(a) == 2


def test_other_ranges_than_counted_are_an_error(spark, tmp_path, small_ranges):
    write(tmp_path / "in" / "a.csv", some_rows(3))
    small_ranges(1000)
    df = ranges.records(spark, str(tmp_path / "in"))
    small_ranges(1500)
    again = df.select("record")  # planned anew, with other ranges
    try:
        n = again.count()
    except Exception as e:
        assert "ranges changed" in str(e)
    else:
        assert n == 300


def test_csv_query_writes_in_every_task(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace
    from pickwise.plans import QUERIES, modelling
    monkeypatch.setattr(modelling, "_out", lambda fx, name: str(tmp_path / name))
    d = spark.range(0, 40, 1, 4).selectExpr("id", "'s' as site_token", "'t' as task", "'h' as history", "'CLICK' as op", "'c' as target_id", "'' as value",
                                            """'[{"candidate_id":"c","tag":"a","text":"x","attrs":""}]' as candidate_elements""")
    got = QUERIES["q1_1_read_csv_ranges"](SimpleNamespace(spark=spark, decisions=d)).collect()
    assert sorted(int(r["id"]) for r in got) == list(range(40)) and {(r["task"], r["n_cands"]) for r in got} == {('t\n"é"\r\n,', 1)}
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 4
