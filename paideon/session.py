"""Session settings and stage tables shared by every job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Joins carry no broadcast hints: Spark broadcasts a side only when its own size
# check (static or at run time) says so, and splits skewed partitions otherwise.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The size of a counted stage table is that of its rows, not of its compressed files.
    "spark.sql.cbo.planStats.enabled": "true",
}

# Off while a dealt stage table is computed: a join on more columns than the rows are dealt by leaves them where they are.
_ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

_local_stage_root: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every job relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "paideon", memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every column costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def stage_root(spark: SparkSession) -> str:
    """Shared folder of the cluster; a private temporary one only in local mode."""
    global _local_stage_root
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_stage_root is None:
        _local_stage_root = tempfile.mkdtemp(prefix="paideon-stage-")
        atexit.register(shutil.rmtree, _local_stage_root, ignore_errors=True)
    return _local_stage_root


def stage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write `df` as a stage table and read it back.

    The result has no lineage to recompute, so a lost executor costs a re-read
    and several consumers share one computation and a columnar, pruned scan.
    With `by` the table is bucketed by these columns, so that windows, groups and joins on them and
    further columns read it where it lies; `df` should be dealt by them, or every task writes to every bucket.
    """
    if by:
        return counted_stage(df, label, by)
    path = f"{stage_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _writer(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_stage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """`stage` as a table of the session whose rows are counted.

    Keys, numbers and flags compress to a hundredth of their size in memory, and Spark would broadcast
    a table by its files that does not fit the driver.
    """
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    table = name.replace("-", "_")
    writer = _writer(df).format("parquet").option("path", f"{stage_root(spark)}/{name}")
    strict = spark.conf.get(_ALL_JOIN_KEYS)
    if by:
        writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
        spark.conf.set(_ALL_JOIN_KEYS, "false")
    try:
        writer.saveAsTable(table)
    finally:
        spark.conf.set(_ALL_JOIN_KEYS, strict)
    spark.sql(f"analyze table {table} compute statistics")
    return spark.table(table)


def _writer(df: DataFrame) -> DataFrameWriter:
    return df.write.mode("errorifexists").option("compression", "zstd")
