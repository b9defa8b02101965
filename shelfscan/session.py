"""Session defaults and durable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "shelfscan", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; on a cluster the submitter's settings stand."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "64m")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where it is unset a
    temporary folder is used in local mode only; on a cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        path = "file://" + (folder := tempfile.mkdtemp(prefix="shelfscan-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(path)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as a parquet table in the shared folder and read back: its lineage is cut, it is compact and
    readable after the loss of any executor. (checkpoint() would keep the constraints of the plan it cut, which double in
    loops that take minima.) release() deletes it; else it stays until the folder is emptied."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


_made: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Deletes every table that written() made in this process: for the end of a job, when no result is read any more."""
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that written() made meanwhile: around a run that has published its results."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _made[before:]


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by hash of a key, if it comes in fewer parts than there are cores (one small file is one part, however much work a
    row is); as it is otherwise, so nothing moves that is large."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def release(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame of written(); nothing may read it any more."""
    if path := getattr(df, "_written", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
