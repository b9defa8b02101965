"""Results as files, the run's lock, and the index's own storage."""

from __future__ import annotations

import csv
import json
import os
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

LOCK_MAX_AGE = 3 * 86400


def _fields(columns: list[str], group: str | None) -> list[str]:
    """The columns in their order, the group before them."""
    return [*([group] if group else []), *(c for c in columns if c != group)]


def write_results(records: DataFrame, path: str, fmt: str, group: str | None = None) -> int:
    """Records in their order as one csv, json or txt file on the driver, row by row as they come; csv has the group first and writes null as nothing,
    json nests the records of a group, without its key, in an array of their own, txt is a path a line with an empty line between groups.
    Gives the number of records."""
    if fmt not in ("csv", "json", "txt"):
        raise ValueError(fmt)
    n, last = 0, object()
    fields = _fields(records.columns, group)
    with open(path, "w", encoding="utf-8", newline="") as f:
        rows: Iterable[dict] = (r.asDict(recursive=True) for r in records.toLocalIterator())
        if fmt == "csv":
            out = csv.DictWriter(f, fields)
            out.writeheader()
            for n, r in enumerate(rows, 1):
                out.writerow({k: "" if r[k] is None else r[k] for k in fields})
            return n
        f.write("[" if fmt == "json" else "")
        for n, r in enumerate(rows, 1):
            begins = bool(group) and (n == 1 or r[group] != last)
            last = r[group] if group else None
            if fmt == "txt":
                f.write(("\n" if begins and n > 1 else "") + r["path"] + "\n")
                continue
            between = "" if n == 1 else "],\n" if begins else ",\n"
            f.write(between + ("[" if begins else "") + json.dumps({k: r[k] for k in fields if k != group}, ensure_ascii=False, default=str))
        f.write(("]" if group and n else "") + "]\n" if fmt == "json" else "")
    return n


def write_distributed(records: DataFrame, folder: str, fmt: str) -> None:
    """The same as a folder of files, written by the executors."""
    writer = records.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").csv(folder)
    elif fmt == "json":
        writer.json(folder)
    elif fmt == "txt":
        records.select("path").write.mode("overwrite").text(folder)
    else:
        raise ValueError(fmt)


class RunLock:
    """One writer at a time. On a local disk: a file with the holder's process, written aside and linked to its name, so it is never seen half written; one of
    an ended process or older than LOCK_MAX_AGE is taken over. An empty one is another program's that is about to fill it, and is held while it is
    young."""

    YOUNG = 60

    def __init__(self, path: str):
        self.path = path

    def _stale(self) -> bool:
        try:
            age = time.time() - os.path.getmtime(self.path)
            with open(self.path) as f:
                held = f.read().strip()
            if age > LOCK_MAX_AGE or not held.isdigit():
                return age > (LOCK_MAX_AGE if held.isdigit() else self.YOUNG)
            os.kill(int(held), 0)
        except (ProcessLookupError, FileNotFoundError, OverflowError):
            return True
        except OSError:
            return False
        return False

    def __enter__(self):
        aside = f"{self.path}.{os.getpid()}.{uuid.uuid4().hex}"
        with open(aside, "w") as f:
            f.write(str(os.getpid()))
        try:
            for _ in range(2):
                try:
                    os.link(aside, self.path)
                    return self
                except FileExistsError:
                    if not self._stale():
                        break
                    gone = f"{aside}.old"  # moved away first: of two that find it stale one gets it
                    try:
                        os.rename(self.path, gone)
                        os.unlink(gone)
                    except FileNotFoundError:
                        pass
            raise BlockingIOError(f"another run holds {self.path}")
        finally:
            os.unlink(aside)

    def __exit__(self, *_):
        os.unlink(self.path)


class SharedLock:
    """The same in a folder of any Hadoop file system, where processes of other machines can't be asked after: made only if it is not there, and taken over
    after LOCK_MAX_AGE."""

    def __init__(self, spark: SparkSession, path: str):
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self):
        if self._fs.exists(self._at) and time.time() * 1000 - self._fs.getFileStatus(self._at).getModificationTime() > LOCK_MAX_AGE * 1000:
            self._fs.delete(self._at, False)
        try:
            self._fs.create(self._at, False).close()
        except Exception as problem:
            raise BlockingIOError(f"another run holds {self._at.toString()}") from problem
        return self

    def __exit__(self, *_):
        self._fs.delete(self._at, False)


class Store:
    """Tables as folders of versions, and numbered manifests that name the versions of all tables at once.

    A writer adds versions first and then one manifest, under the next number, whole or not at all; nothing is deleted or written over on the way. Readers take
    the newest manifest, so a crash anywhere leaves what was published before, of all tables. Two writers can't publish the same number.
    A table may have several versions, of which each adds rows (append)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> tuple[int, dict]:
        """Number and content of the newest: table -> its versions, and meta."""
        numbers = self._manifests()
        if not numbers:
            return 0, {"tables": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{numbers[-1]:012d}"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, number: int, content: dict) -> None:
        aside, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{number:012d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise OSError(f"{final} exists: another run published")

    def has(self, table: str) -> bool:
        return table in self.manifest()[1]["tables"]

    def read(self, table: str) -> DataFrame:
        """The current rows; columns that older files lack are null."""
        versions = self.manifest()[1]["tables"].get(table)
        if not versions:
            raise FileNotFoundError(table)
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.folder}/{table}/{v}" for v in versions))

    def version(self, table: str, df: DataFrame, sort: list[str] | None = None) -> str:
        """Writes rows as a version that nothing names yet. sort: rows range partitioned and sorted, so that filters skip row groups."""
        name = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        if sort:
            df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        df.write.parquet(f"{self.folder}/{table}/{name}")
        return name

    def publish(self, tables: dict[str, DataFrame], meta: dict[str, str | None] | None = None, append: dict[str, DataFrame] | None = None, sort: dict[str, list[str]] | None = None) -> None:
        """All of these tables (rows in place of the old ones, or added to them) and meta values (None drops one) at once."""
        number, content = self.manifest()
        sort = sort or {}
        new = {t: [self.version(t, df, sort.get(t))] for t, df in tables.items()}
        for t, df in (append or {}).items():
            new[t] = [*content["tables"].get(t, []), self.version(t, df, sort.get(t))]
        kept = content["meta"] | (meta or {})
        self._put(number + 1, {"tables": content["tables"] | new, "meta": {k: v for k, v in kept.items() if v is not None}})

    def write(self, table: str, df: DataFrame, sort: list[str] | None = None) -> None:
        self.publish({table: df}, sort={table: sort} if sort else None)

    def compact(self, table: str, files: int, sort: list[str] | None = None) -> None:
        """The current rows in so many files, sorted; versions and manifests that are no longer current are deleted."""
        df = self.read(table)
        self.write(table, df if sort else df.coalesce(files), sort)
        self.sweep()

    def sweep(self) -> None:
        """Deletes what the newest manifest does not name. Readers of older versions must be done."""
        number, content = self.manifest()
        for n in self._manifests()[:-1]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{n:012d}"), False)
        for table, versions in content["tables"].items():
            for s in self._fs.listStatus(self._path(f"{self.folder}/{table}")):
                if s.isDirectory() and s.getPath().getName() not in versions:
                    self._fs.delete(s.getPath(), True)

    def clear(self, keep: tuple[str, ...] = ("roots",)) -> None:
        """Forgets all tables but those named, and meta."""
        number, content = self.manifest()
        if number:
            self._put(number + 1, {"tables": {t: v for t, v in content["tables"].items() if t in keep}, "meta": {}})
            for t in content["tables"].keys() - set(keep):
                self._fs.delete(self._path(f"{self.folder}/{t}"), True)
            self.sweep()

    def get_meta(self, key: str) -> str | None:
        return self.manifest()[1]["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        self.publish({}, {key: value})
