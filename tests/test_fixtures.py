"""The derived decision table: pages are named in it, not written into it."""
from pyspark.sql import functions as F

from pickwise.plans import QUERIES
from pickwise.sources.fixtures import Fixture

SF = "/root/testdata/sf0.001"


def test_pages_are_not_written(spark):
    fx = Fixture(spark, SF)
    d = fx.decisions
    assert "cleaned_html" not in fx._staged["decisions"].columns
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(d.select("id", "task", "cands", "candidate_elements")) and "Join" in plan(d.select("cleaned_html"))
    pages = fx.table("pages")
    real = d.filter("id % 3 <> 0").withColumn("page_id", F.col("id") % pages.count()).join(pages, "page_id")
    assert real.filter("cleaned_html = html").count() == d.filter("id % 3 <> 0").count() > 0


def test_rows_of_pages_that_repeat(spark, tmp_path):
    """Every row of a page id counts, as in DECISIONS_SQL."""
    import os
    for f in os.listdir(SF):
        if f != "pages.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    rows = [(0, "u", "<p>a"), (1, "u", "<p>b"), (1, "u", "<p>c"), (1, "u", "<p>c"), (None, "u", "<p>n")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Fixture(spark, str(tmp_path)).decisions.groupBy("id").agg(F.array_sort(F.collect_list("cleaned_html")).alias("h")).collect()
    want = {0: ["<p>a"], 1: ["<p>b", "<p>c", "<p>c"]}
    for r in got:
        if r["id"] % 3:
            assert r["h"] == want.get(r["id"] % 5, []), r
        else:
            assert len(r["h"]) == len(want.get(r["id"] % 5, [None]))


def test_arrivals_hold_no_page(spark):
    import glob
    from pickwise.session import scratch_dir
    QUERIES["q1_5_read_stream"](Fixture(spark, SF)).count()
    newest = max(glob.glob(f"{scratch_dir(spark)}/**/*arrivals*", recursive=True), key=lambda p: __import__("os").stat(p).st_mtime)
    assert "cleaned_html" not in spark.read.parquet(newest).columns


def _tables(spark, tmp_path, part, lines):
    """The smallest data folder with these parts and lines, and an order and customer for every line."""
    import os
    for f in os.listdir(SF):
        if f not in ("part.parquet", "lineitem.parquet"):
            os.symlink(f"{SF}/{f}", tmp_path / f)
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    return Fixture(spark, str(tmp_path))


def test_lines_travel_with_their_part_only(spark, tmp_path):
    fx = _tables(spark, tmp_path, [(1, "a b", "T", "B#1"), (2, "c", "T", "B#1")], [(1, 1, 1, 7, 2.0, None), (1, 2, 2, 7, 3.0, None)])
    assert [r["x"]["tie"] for r in fx._lines(F.lit(True)).collect()] == [None, None]


def test_lines_of_a_part_key_that_repeats_stay_together(spark, tmp_path):
    parts = [(1, "a", "T", "B#1"), (1, "b", "T", "B#1")]
    fx = _tables(spark, tmp_path, parts, [(1, 1, 1, s, 2.0, None) for s in (9, 8)] + [(1, 1, None, 7, 2.0, None)])
    (row,) = fx._lists(F.lit(True)).collect()
    assert [c["text"] for c in row["cs"]] == ["a", "b", "a", "b"]


def test_slices_make_the_same_rows(spark, monkeypatch):
    from pickwise.sources import fixtures
    whole = Fixture(spark, SF).decisions
    monkeypatch.setattr(fixtures, "SLICE", 2000)
    fx = Fixture(spark, SF)
    assert len(fx._made()) > 1
    assert fx.decisions.exceptAll(whole).isEmpty() and whole.count() == fx.decisions.count() > 0


def _shuffle_files(spark):
    import glob
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}


def test_a_write_leaves_no_shuffle_files(spark):
    import time
    from pickwise.session import SHUFFLE_CLEANUP, materialize
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    made = materialize(spark.range(1000).repartition(4, "id"), "shuffled")
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and made.count() == 1000 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_arrivals_are_not_shuffled(spark):
    import os
    from pickwise.plans.modelling import _stream_source
    fx = Fixture(spark, SF)
    n, files = fx.decisions.count(), _shuffle_files(spark)
    path = _stream_source(fx)
    assert sum(os.path.getsize(f) for f in _shuffle_files(spark) - files if f.endswith(".data")) < 20_000
    made = spark.read.parquet(path)
    assert made.count() == made.select("id").distinct().count() == n and len(made.inputFiles()) >= 2 * spark.sparkContext.defaultParallelism - 1
