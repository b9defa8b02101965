"""The live feed of changes: folded a batch at a time into the index."""

from __future__ import annotations

import itertools
import os
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.constants import SKIP_DIRS
from shelfscan.operators.roots import with_root
from shelfscan.session import scratch, written


def skipped(path: Column) -> Column:
    """Some folder above is never walked."""
    above = F.slice(F.split(F.lower(path), r"[/\\]"), 1, F.greatest(F.lit(0), F.size(F.split(path, r"[/\\]")) - 1))
    return F.exists(above, lambda p: p.isin(SKIP_DIRS) | p.startswith("$"))


def fold(events: DataFrame) -> DataFrame:
    """path, op (upsert or delete), is_dir, ts of a batch of events(event_id, ts, op, path, to_path, is_dir): the last of each path by (ts,
    event_id). A move deletes its source and upserts its target; a changed folder is no event; null paths are left out.

    An aggregate of structs with map-side combine: a path with a third of all events is no hot group.
    """
    known = events.where(~((F.col("op") == "modified") & (F.col("is_dir") == 1)))
    step = F.when(F.col("op") == "moved", F.array(F.struct(F.col("path").alias("p"), F.lit("delete").alias("o")), F.struct(F.col("to_path").alias("p"), F.lit("upsert").alias("o")))).otherwise(
        F.array(F.struct(F.col("path").alias("p"), F.when(F.col("op") == "deleted", "delete").otherwise("upsert").alias("o")))
    )
    flat = known.select("event_id", "ts", "is_dir", F.explode(step).alias("x")).select("event_id", "ts", "is_dir", "x.p", "x.o").where(F.col("p").isNotNull() & ~skipped(F.col("p")))
    return flat.groupBy(F.col("p").alias("path")).agg(F.max(F.struct("ts", "event_id", "o", "is_dir")).alias("x")).select("path", F.col("x.o").alias("op"), "x.is_dir", "x.ts")


def apply(state: DataFrame, folded: DataFrame) -> DataFrame:
    """state(path, is_dir, ts) after a folded batch: deletes first, with all beneath a deleted folder, then upserts."""
    gone = folded.where(F.col("op") == "delete").select("path")
    was_folder = state.where(F.col("is_dir") == 1).join(gone, "path", "left_semi").select("path")
    left = with_root(state.join(folded.select("path"), "path", "left_anti"), was_folder, "path", "__in").where(F.col("__in").isNull()).drop("__in")
    return left.unionByName(folded.where(F.col("op") == "upsert").select("path", "is_dir", "ts"))


#: Batches between two whole states on disk.
BASE_EVERY = 20


class Follower:
    """Follows a stream of events by foreachBatch. A batch writes only its folded changes, to a folder named by its number, so a batch replayed after a
    failure replaces itself; every BASE_EVERY batches the whole state is written too. The state after a batch is the last whole one with
    the changes since applied in order."""

    def __init__(self, folder: str, base_every: int = BASE_EVERY):
        self.folder, self.base_every = folder, base_every

    def state(self, spark, batch: int) -> DataFrame:
        """path, is_dir, ts after a batch; empty before the first."""
        base = (batch + 1) // self.base_every * self.base_every - 1
        if base >= 0:
            state = spark.read.parquet(f"{self.folder}/state-{base}")
        else:
            state = spark.createDataFrame([], "path string, is_dir int, ts timestamp")
        for n in range(base + 1, batch + 1):
            state = apply(state, spark.read.parquet(f"{self.folder}/changes-{n}"))
        return state

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        changes = fold(events)
        changes.write.mode("overwrite").parquet(f"{self.folder}/changes-{batch}")
        if (batch + 1) % self.base_every == 0:
            before = self.state(spark, batch - 1)
            apply(before, spark.read.parquet(f"{self.folder}/changes-{batch}")).write.mode("overwrite").parquet(f"{self.folder}/state-{batch}")

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False):
        writer = events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def really(paths: DataFrame) -> DataFrame:
    """path, there: whether something is at each path now, asked where all executors see it."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([os.path.lexists(p) for p in b.column(0).to_pylist()], pa.bool_())], ["path", "there"])

    return paths.where(F.col("path").isNotNull()).select("path").distinct().mapInArrow(run, "path string, there boolean")


def looked_at(paths: DataFrame, deep: DataFrame) -> DataFrame:
    """Rows of a walk of these paths, and of all beneath those that are also in deep(path): a folder that appears may bring contents that have no events of
    their own. Links and what is gone meanwhile give none."""
    from shelfscan.sources import walk

    marked = paths.join(deep.select("path", F.lit(True).alias("deep")).distinct(), "path", "left").select("path", F.coalesce("deep", F.lit(False)).alias("deep"))

    def run(batches):
        for b in batches:
            for path, below in zip(*(c.to_pylist() for c in b.columns)):
                rows = list(walk.one(path))
                chunks = itertools.chain(rows, walk.entries(path, True) if rows and rows[0][6] and below else ())
                while part := [r for r in itertools.islice(chunks, 10_000) if r[7]]:
                    yield walk.batch(part)

    rows = marked.mapInArrow(run, walk.SCHEMA)
    return rows.where(~skipped(F.col("path"))).dropDuplicates(["path"])


class IndexFollower:
    """Takes a stream of events into an index by foreachBatch: what a batch says went is dropped, with all beneath it, if it is really gone; what it says came or changed
    is looked at, folders that came are walked, texts are read again. A batch that is replayed after a failure is known by its number, which is published with
    its changes; a run that holds the index makes the batch wait."""

    def __init__(self, index, feed: str = "feed", tries: int = 30, wait: float = 2.0):
        self.index, self.key, self.tries, self.wait = index, f"batch:{feed}", tries, wait

    def __call__(self, events: DataFrame, batch: int) -> None:
        if int(self.index.store.get_meta(self.key) or -1) >= batch:
            return
        with scratch(events.sparkSession):
            folded = written(fold(events), "folded")
            there = written(folded.join(really(folded.select("path")), "path"), "there")
            gone = there.where("NOT there").select("path")
            came = there.where("there")
            seen = written(looked_at(came.select("path"), came.where("is_dir = 1").select("path")), "seen")
            for left in range(self.tries, 0, -1):
                try:
                    return self.index.changed(gone, seen, {self.key: str(batch)})
                except BlockingIOError:
                    if left == 1:
                        raise
                    time.sleep(self.wait)

    start = Follower.start


class Poller:
    """A source of events for file systems that send none: what a walk of the roots shows against the index, written as a file of events a tick, which a stream
    reads. Ids go on from tick to tick."""

    def __init__(self, index, folder: str):
        self.index, self.folder = index, folder

    def tick(self) -> int:
        """Writes what changed since the index was last published; the number of events."""
        from shelfscan.operators import incremental
        from shelfscan.sources import walk

        spark = self.index.spark
        roots = [r["path"] for r in self.index.roots.select("path").collect() if r["path"] and os.path.isdir(r["path"])]
        with scratch(spark):
            seen = written(walk.walk(spark, roots), "walk")
            files = self.index.files
            actions = incremental.classify(seen.where("listed = 1"), files).where("action IN ('new', 'changed')")
            walked = spark.createDataFrame([(r,) for r in roots], "path string")
            gone = incremental.vanished(files, seen.where("listed = 1"), walked, seen.where("listed = 0").select("path")).select("path", F.lit("deleted").alias("op"), "is_dir")
            came = actions.join(seen.select("path", "is_dir"), "path").select("path", F.when(F.col("action") == "new", "created").otherwise("modified").alias("op"), "is_dir")
            now = time.time()
            events = came.unionByName(gone).select(
                (F.lit(int(now * 1000)) * 1_000_000 + F.monotonically_increasing_id() % 1_000_000).alias("event_id"), F.lit(now).cast("timestamp").alias("ts"), "op", "path",
                F.lit(None).cast("string").alias("to_path"), "is_dir",
            )
            held = written(events, "events")
            n = held.count()
            if n:
                held.write.mode("append").parquet(self.folder)
            return n


EVENTS = "event_id long, ts timestamp, op string, path string, to_path string, is_dir int"


def follow(index, every: float, ticks: int = 0) -> None:
    """The live feed: a poller's events through a stream into the index, a tick every so many seconds."""
    folder = f"{index.store.folder}/feed"
    poller, follower, n = Poller(index, f"{folder}/events"), IndexFollower(index), 0
    while not ticks or n < ticks:
        time.sleep(every if n else 0)
        if poller.tick():
            source = index.spark.readStream.schema(EVENTS).parquet(f"{folder}/events")
            follower.start(source, f"{folder}/checkpoint", available_now=True).awaitTermination()
        n += 1
