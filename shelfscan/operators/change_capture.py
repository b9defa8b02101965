"""Log-based change capture: per-partition offsets, a write-ahead batch plan, an idempotent sink.

The log is an append-only table of observations; a log partition is a registered root and the offset of an
observation is its moment (`seen`). A run

1. plans: for each partition the range (committed offset, highest offset in the log] is written ahead to the shared
   folder, before any row is worked on; a plan found there without a commit is replayed as it stands;
2. reads exactly the planned ranges: rows outside them are dropped before anything is folded, so a replay gives what the
   plan meant, whatever the log has got since;
3. folds them to one observation a key and drops the keys that the sink holds at the same or a later offset, so that
   rows a broken run already delivered are not repeated;
4. commits: the plan's end offsets become the committed ones.

Observations that arrive late, behind their partition's committed offset, are settled (the run that committed the
offset owned them); duplicates and several observations of a key fold to the greatest offset.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan.operators.roots import with_root
from shelfscan.session import shared_dir

#: mtimes closer than this are one.
SAME_MTIME = 1e-6
#: A plan holds one line a root; a register with more than this is refused.
MAX_PARTITIONS = 1_000_000
#: Up to so many ranges meet the log by broadcast (about 2 MB); more are joined as Spark sees fit.
BROADCAST_RANGES = 10_000

PLAN = T.StructType(
    [T.StructField("root", T.StringType()), T.StructField("after", T.DoubleType()), T.StructField("upto", T.DoubleType())]
)


class PlanLog:
    """Write-ahead plans in `folder` (any Hadoop file system): N.plan, then N.commit."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _write(self, name: str, text: str) -> None:
        """Whole or not at all: written aside, then renamed."""
        aside, final = self._path(f"{self.folder}/.{name}.tmp"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(aside, final):
            raise OSError(f"{final} exists: another run planned the same batch")

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _numbers(self, kind: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(kind) and n.split(".")[0].isdigit())

    def open_plan(self) -> tuple[int, list[dict]] | None:
        """The plan that was written but never committed."""
        left = sorted(set(self._numbers(".plan")) - set(self._numbers(".commit")))
        return (left[0], json.loads(self._read(f"{left[0]}.plan"))) if left else None

    def offsets(self) -> dict[str, float]:
        """Committed offset of each partition, from the commits alone."""
        held: dict[str, float] = {}
        for n in self._numbers(".commit"):
            for x in json.loads(self._read(f"{n}.plan")):
                held[x["root"]] = max(x["upto"], held.get(x["root"], float("-inf")))
        return held

    def plan(self, ranges: list[dict]) -> tuple[int, list[dict]]:
        """Writes the next plan ahead, or gives back the uncommitted one to be replayed."""
        if left := self.open_plan():
            return left
        n = max(self._numbers(".plan"), default=0) + 1
        self._write(f"{n}.plan", json.dumps(ranges))
        return n, ranges

    def commit(self, n: int) -> None:
        self._write(f"{n}.commit", "")


def _under(scan: DataFrame, roots: DataFrame) -> DataFrame:
    return with_root(scan.where((F.col("is_dir") == 0) & F.col("seen").isNotNull()).select("path", "size", "mtime", "seen"), roots, "path", "root").where(F.col("root").isNotNull())


def in_ranges(scan: DataFrame, roots: DataFrame, ranges: list[dict]) -> DataFrame:
    """path, size, mtime, seen, root of the observations that the planned ranges hold. The least and the greatest offset of the plan are
    plain conditions on `seen`, which reach the scan; a root's own range is a join with the plan."""
    starts = [x["after"] for x in ranges]
    if ranges:
        scan = scan.where(F.col("seen") <= max(x["upto"] for x in ranges))
    if starts and None not in starts:
        scan = scan.where(F.col("seen") > min(starts))
    plan = scan.sparkSession.createDataFrame([(x["root"], x["after"], x["upto"]) for x in ranges], PLAN)
    plan = F.broadcast(plan) if len(ranges) <= BROADCAST_RANGES else plan
    held = _under(scan, roots).join(plan, "root").where((F.col("after").isNull() | (F.col("after") < F.col("seen"))) & (F.col("seen") <= F.col("upto")))
    return held.select("path", "size", "mtime", "seen", "root")


def batch_ranges(scan: DataFrame, roots: DataFrame, committed: dict[str, float] | None = None) -> list[dict]:
    """One range for each root that the log has something new of: from its committed offset (roots.last_index, or the later one in
    `committed`) up to the log's end. The least committed offset reaches the scan; one aggregate with map-side combine, and a row a root
    reaches the driver."""
    known = roots.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("last_index").alias("after")).limit(MAX_PARTITIONS + 1).collect()
    if len(known) > MAX_PARTITIONS:
        raise ValueError("more roots than a plan may hold")
    later = committed or {}
    after = {r["path"]: max((x for x in (r["after"], later.get(r["path"])) if x is not None), default=None) for r in known}
    if after and None not in after.values():
        scan = scan.where(F.col("seen") > min(after.values()))
    ends = _under(scan, roots).groupBy("root").agg(F.max("seen").alias("upto")).collect()
    return sorted(({"root": r["root"], "after": after[r["root"]], "upto": r["upto"]} for r in ends if after[r["root"]] is None or r["upto"] > after[r["root"]]), key=lambda x: x["root"])


def same(a: Column, b: Column, gap: float | None = None) -> Column:
    """Null equals null and differs from every value; numbers closer than gap are equal."""
    near = (a == b) if gap is None else (F.abs(a - b) < gap)
    return F.coalesce(near, F.lit(False)) | (a.isNull() & b.isNull())


def pending(scan: DataFrame, files: DataFrame, roots: DataFrame, ranges: list[dict], retry_status: str = "error") -> DataFrame:
    """path, size, mtime, seen of each path the planned ranges call work for, each once.

    The newest observation of a path within its root's range decides (equal moments: the larger size and mtime, so that the choice does not
    depend on order); it counts if the sink `files` has no row of the path or one written before it. It is work if the sink has no row,
    size or mtime differ, or the row's status is `retry_status`. Rows without path, moment or root are no observation. Several sink rows
    of a path count as the latest written. Empty tables give no rows. The fold is one aggregate with map-side combine, so a path with a
    third of the log is no hot group.
    """
    newest = in_ranges(scan, roots, ranges).groupBy("path").agg(F.max(F.struct("seen", "size", "mtime")).alias("x")).select("path", "x.*")
    sink = (
        files.where(F.col("path").isNotNull())
        .groupBy(F.col("path").alias("f_path"))
        .agg(F.max(F.struct("indexed", "size", "mtime", "status")).alias("f"))
    )
    joined = newest.join(sink, F.col("path") == F.col("f_path"), "left")
    fresh = F.col("f_path").isNull() | (F.col("f.indexed") < F.col("seen"))
    work = (
        F.col("f_path").isNull()
        | ~same(F.col("size"), F.col("f.size"))
        | ~same(F.col("mtime"), F.col("f.mtime"), SAME_MTIME)
        | F.coalesce(F.col("f.status") == retry_status, F.lit(False))
    )
    return joined.where(fresh & work).select("path", "size", "mtime", "seen")


def run_pending(scan: DataFrame, files: DataFrame, roots: DataFrame, folder: str | None = None) -> tuple[DataFrame, PlanLog, int]:
    """Plans ahead (or takes up the plan a broken run left), and gives the work of that plan with the log to commit to."""
    log = PlanLog(scan.sparkSession, f"{folder or shared_dir(scan.sparkSession)}/plans" + ("" if folder else f"-{uuid.uuid4().hex}"))
    left = log.open_plan()
    n, ranges = left or log.plan(batch_ranges(scan, roots, log.offsets()))
    return pending(scan, files, roots, ranges), log, n


def run(scan: DataFrame, files: DataFrame, roots: DataFrame, folder: str | None = None) -> DataFrame:
    """One whole run in `folder` (a fresh one in the shared folder if none is given): the plan is written ahead, its work delivered to the
    sink as one batch, the plan committed. Gives the batch as the sink holds it. A run that broke off anywhere is finished by the next: the
    open plan is replayed and its batch overwrites what was delivered of it."""
    folder = folder or f"{shared_dir(scan.sparkSession)}/capture-{uuid.uuid4().hex}"
    work, log, n = run_pending(scan, files, roots, folder)
    sink = DedupSink(scan.sparkSession, folder)
    sink.write(work, n)
    log.commit(n)
    return sink.batch(n, work.schema)


class DedupSink:
    """A keyed table: one folder a batch under `folder`/data, written by overwrite, so a replayed batch replaces itself;
    the current state keeps of each key the row with the greatest offset (key null: dropped)."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "path", offset: str = "seen"):
        self.spark, self.folder, self.key, self.offset = spark, folder, key, offset

    def write(self, df: DataFrame, n: int) -> None:
        df.where(F.col(self.key).isNotNull()).write.mode("overwrite").parquet(f"{self.folder}/data/batch={n}")

    def batch(self, n: int, schema: T.StructType) -> DataFrame:
        """What batch n delivered."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/data/batch={n}")

    def state(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/data")
        rest = [c for c in rows.columns if c not in (self.key, self.offset, "batch")]
        return rows.groupBy(self.key).agg(F.max(F.struct(self.offset, *rest)).alias("x")).select(self.key, "x.*")
