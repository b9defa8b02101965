"""Folders walked in rounds of tasks, and as a Spark data source with a partition a folder of the first level."""

from __future__ import annotations

import itertools
import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfscan.functions.constants import CLOUD_MASK, SKIP_DIRS
from shelfscan.session import written

#: A folder still to be looked into, in place of listed.
LEFT = -1
#: Rows that one folder's task gives before it hands on what is left.
A_TASK = 50_000

SCHEMA = "path string, name string, ext string, size bigint, mtime double, is_cloud int, is_dir int, listed int"
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def skip(name: str) -> bool:
    return name.startswith("$") or name.lower() in SKIP_DIRS


def _row(entry: os.DirEntry, folder: bool) -> tuple:
    s = entry.stat(follow_symlinks=False)
    cloud = int(bool(getattr(s, "st_file_attributes", 0) & CLOUD_MASK))
    ext = "" if folder else os.path.splitext(entry.name)[1].lower()
    return entry.path, entry.name, ext, 0 if folder else s.st_size, s.st_mtime, cloud, int(folder), 1


class _Path:
    """A path with what os.DirEntry has."""

    def __init__(self, path: str):
        self.path, self.name = path, os.path.basename(path)

    def stat(self, follow_symlinks: bool = False) -> os.stat_result:
        return os.stat(self.path, follow_symlinks=follow_symlinks)


def one(path: str):
    """The row of one path; none for links, other kinds and what is not there."""
    try:
        path.encode()
        kind = stat.S_IFMT(os.lstat(path).st_mode)
        if kind in (stat.S_IFDIR, stat.S_IFREG):
            yield _row(_Path(path), kind == stat.S_IFDIR)
    except (OSError, ValueError):
        return


def entries(folder: str, deep: bool, most: int | None = None):
    """Rows of what is in a folder (and beneath, if deep); links are not followed, folders never walked not shown, names that
    are no UTF-8 left out. A folder that can't be listed gives one row with listed = 0. After about `most` rows the folders not yet looked into are given
    as rows with listed = LEFT."""
    stack, n = [folder], 0
    while stack:
        here = stack.pop()
        if most is not None and n > most:
            yield here, os.path.basename(here), "", 0, None, 0, 1, LEFT
            continue
        try:
            with os.scandir(here) as it:
                found = sorted(it, key=lambda e: e.name)
        except OSError:
            yield here, os.path.basename(here), "", 0, None, 0, 1, 0
            continue
        for e in found:
            try:
                e.name.encode()
                if e.is_symlink():
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir and skip(e.name):
                    continue
                if is_dir or e.is_file(follow_symlinks=False):
                    n += 1
                    yield _row(e, is_dir)
                if is_dir and deep:
                    stack.append(e.path)
            except (OSError, UnicodeEncodeError):
                continue


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class WalkReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self):
        parts = []
        for root in self.roots:
            parts.append(Part(root, False))
            parts += [Part(r[0], True) for r in entries(root, False) if r[6] and r[7]]
        return parts

    def read(self, partition):
        if partition is None:  # no roots
            return
        yield from entries(partition.folder, partition.deep)


class WalkSource(DataSource):
    """spark.read.format("shelfwalk").option("roots", "/a\\n/b").load()"""

    @classmethod
    def name(cls):
        return "shelfwalk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WalkReader(_outer(r for r in self.options.get("roots", "").split("\n") if r))


def _outer(roots) -> list[str]:
    """The roots that lie in no other."""
    bare = sorted({r.rstrip("/\\") or "/" for r in roots}, key=len)
    return [r for r in bare if not any(r != o and r.lower().startswith(o.lower().rstrip("/\\") + os.sep) for o in bare)]


def _listed(most: int):
    def run(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = entries(folder, True, most)
                while part := list(itertools.islice(rows, 10_000)):
                    yield batch(part)

    return run


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)


def walk(spark: SparkSession, roots: list[str], most: int = A_TASK) -> DataFrame:
    """Every file and folder beneath the roots (nested ones once); unlistable folders have listed = 0.

    In rounds: a task walks a folder for about `most` rows, and the folders it did not get to are spread over all tasks of the next round. So neither a deep
    nor a lopsided tree is one task's, and the driver lists nothing.
    """
    left, out = spark.createDataFrame([(r,) for r in _outer(roots)], "path string"), None
    while True:
        parts = spark.sparkContext.defaultParallelism
        rows = written(left.repartition(parts).mapInArrow(_listed(most), SCHEMA), "walk")
        found = rows.where(F.col("listed") != LEFT)
        out = found if out is None else out.unionByName(found)
        left = rows.where(F.col("listed") == LEFT).select("path")
        if not left.limit(1).count():
            return out
