"""Session helpers: settings the library expects and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

FORCED = {
    # Matching and regex work costs far more per byte than a scan: keep small shuffles parallel.
    # Large shuffles are sized by the advisory partition size as usual.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Spark 4.1 reports the hash partitioning of a union whose inputs are co-partitioned, but adaptive
    # execution may coalesce the inputs differently; a later aggregate without its own shuffle then
    # sees one key in two partitions. Off means one more exchange after such a union.
    "spark.sql.unionOutputPartitioning": "false",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> None:
    """Set the forced settings, and the defaults that the session left open."""
    for key, value in SESSION_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    for key, value in FORCED.items():
        spark.conf.set(key, value)


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name that stays right below an aggregate or window on the partitioning key."""
    key = "spark.sql.unionOutputPartitioning"
    frames[0].sparkSession.conf.set(key, FORCED[key])
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pin(df: DataFrame, *cols: str) -> DataFrame:
    """Compute the named columns here, once per row.

    The optimizer inlines a column into a later expression that names it once, even when that is the
    body of an array function and runs per element, and pushes filters on it below its definition.
    A one-row generator is a boundary for both.
    """
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*cols)))).select(*df.columns)


def local_session(cpus: int | str = "*", memory: str = "16g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("pickwise")
    for key, value in (SESSION_DEFAULTS | FORCED).items():
        b = b.config(key, value)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediates and checkpoints, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is made only on a local master, where
    one machine is the whole cluster; elsewhere an unset folder is an error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="pickwise-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


_written: list[str] = []  # folders that this process has materialized


def materialize(df: DataFrame, name: str, *more: DataFrame, **options: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back (cuts the lineage); options are the writer's.

    More frames of the same columns are added to it one after the other. Nothing else reads the shuffle files of the write, so they go with it, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/pickwise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").options(**options).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(since: int = 0) -> list[str]:
    """Folders materialized so far, from the ``since``-th on."""
    return _written[since:]


def clear(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Delete materialized folders, but for those that ``keep`` reads. Frames that read the others are void then."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    held = {of(p).getParent().toUri().getPath() for p in keep.inputFiles()} if keep is not None else set()
    for path in paths:
        to = of(path)
        if to.toUri().getPath() not in held:
            to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
