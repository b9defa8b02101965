"""Folders with all that is beneath them, and the index as a tree."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.strings import human, local_time, path_parts, root_part, within


def rollup(files: DataFrame) -> DataFrame:
    """root, folder (its parts joined by `/`, '' for the root), size, files of every folder that has a row or holds one.

    Every file counts for each folder above it: the path is cut up in the row, so one aggregate with map-side combine does it; the top
    folder is one key however many files it has. Null sizes count 0; null paths are left out.
    """
    rows = files.where(F.col("path").isNotNull()).select(root_part(F.col("path")).alias("root"), path_parts(F.col("path")).alias("parts"), "size", "is_dir")
    depth = F.when(F.col("is_dir") == 1, F.size("parts")).otherwise(F.size("parts") - 1)
    level = rows.select("root", "parts", "size", "is_dir", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), depth))).alias("k"))
    folder = F.array_join(F.slice("parts", 1, F.col("k")), "/")
    file = F.col("is_dir") == 0
    return level.groupBy("root", folder.alias("folder")).agg(F.sum(F.when(file, F.coalesce("size", F.lit(0))).otherwise(0)).alias("size"), F.count_if(file).alias("files"))


def listing(files: DataFrame, under: str | None = None) -> DataFrame:
    """path, type, size (null for folders), modified in order of path; under a folder: it and all beneath."""
    if under:
        files = files.where(within(F.col("path"), under) | (F.col("path") == under.rstrip("/\\")))
    folder = F.col("is_dir") == 1
    return files.select(
        "path", F.when(folder, "folder").otherwise("file").alias("type"), F.when(~folder, F.coalesce("size", F.lit(0))).alias("size"),
        F.when(F.coalesce(F.col("mtime"), F.lit(0.0)) != 0, local_time(F.col("mtime"))).alias("modified"),
    ).orderBy("path")


def counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("is_dir") == 1).alias("folders"), F.count_if(F.col("is_dir") == 0).alias("files"))


def nodes(files: DataFrame) -> DataFrame:
    """root, depth, name, is_dir, size, files, last, k of every folder (also those that have no row of their own) and file: what a drawing shows.

    k orders them depth first, folders before files, without case; last says that no sibling follows. The last of each folder is an aggregate
    with map-side combine that meets its own row by the whole key, so a folder of any number of files is no hot group.
    """
    key = lambda p, of: F.concat(F.lit(of), F.lower(p), F.lit("\x00"), p)
    folders = rollup(files).select("root", F.when(F.col("folder") != "", F.split("folder", "/")).otherwise(F.array().cast("array<string>")).alias("parts"), F.lit(1).alias("is_dir"), "size", "files")
    rows = files.where(F.col("path").isNotNull() & (F.col("is_dir") == 0)).select(root_part(F.col("path")).alias("root"), path_parts(F.col("path")).alias("parts"), F.lit(0).alias("is_dir"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("files"))
    leaf = F.size("parts") - 1
    keyed = folders.unionByName(rows).withColumn("k", F.transform("parts", lambda p, i: F.when((F.col("is_dir") == 0) & (i == leaf), key(p, "1")).otherwise(key(p, "0"))))
    keyed = keyed.select("root", F.size("parts").alias("depth"), F.coalesce(F.try_element_at("parts", F.lit(-1)), F.lit("")).alias("name"), "is_dir", "size", "files", "k")
    above = F.slice("k", 1, F.greatest(F.lit(0), F.size("k") - 1))
    ends = keyed.groupBy("root", above.alias("above")).agg(F.max("k").alias("k")).select("root", "k", F.lit(True).alias("last"))
    return keyed.join(ends, ["root", "k"], "left").select("root", "depth", "name", "is_dir", "size", "files", F.coalesce("last", F.lit(False)).alias("last"), "k")


def _in_order(files: DataFrame) -> Iterator:
    shown = nodes(files).orderBy("root", "k").select("root", "depth", "name", "is_dir", "size", "files", "last", human(F.col("size")).alias("human"))
    return shown.toLocalIterator(prefetchPartitions=True)


def drawing(files: DataFrame) -> Iterator[str]:
    """Lines of the tree, with totals at folders. The driver holds a partition of the sorted rows and the open folders."""
    rails: list[str] = []  # what stands before an entry, a piece an open folder
    n = None
    for n, r in enumerate(_in_order(files)):
        total = f"  [{r['human']}, {r['files']:,} file{'' if r['files'] == 1 else 's'}]"
        if not r["depth"]:
            if n:
                yield ""
            rails.clear()
            yield (r["root"] if r["is_dir"] else r["name"]) + total
            continue
        del rails[r["depth"] - 1 :]
        yield "".join(rails) + ("└── " if r["last"] else "├── ") + (r["name"] + "/" + total if r["is_dir"] else f"{r['name']}  ({r['human']})")
        rails.append("    " if r["last"] else "│   ")
    if n is not None:
        yield ""


def as_json(files: DataFrame) -> Iterator[str]:
    """The tree as pieces of one JSON text: an array of the roots, of each folder its name, size, files, then its folders, then its files (items).
    Pieces come as the sorted rows do."""
    text = lambda s: json.dumps(s, ensure_ascii=False)
    open_: list[list] = []  # of each open folder: the list being written, and whether it has an entry

    def close(depth: int) -> str:
        ends = []
        while len(open_) > depth:
            ends.append("]}" if open_.pop()[0] == "items" else '], "items": []}')
        return "".join(ends)

    yield "["
    first = True
    for r in _in_order(files):
        yield close(r["depth"])
        at = open_[-1] if open_ else None
        if at and not r["is_dir"] and at[0] == "folders":
            yield '], "items": ['
            at[:] = ["items", False]
        yield ("" if first else ",") + "\n" if at is None else (",\n" if at[1] else "\n") + " " * r["depth"]
        first = False
        if at:
            at[1] = True
        if r["is_dir"]:
            yield f'{{"name": {text(r["name"] if r["depth"] else r["root"])}, "size": {r["size"]}, "files": {r["files"]}, "folders": ['
            open_.append(["folders", False])
        else:
            yield f'{{"name": {text(r["name"])}, "size": {r["size"]}}}'
    yield close(0) + "]\n"
