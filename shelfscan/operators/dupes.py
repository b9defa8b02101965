"""Duplicates: by name and size, by content, by likeness; what to keep of each set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.functions.constants import FILE_COLUMNS
from shelfscan.functions.strings import within
from shelfscan.operators.similarity import near_images, near_texts, numbered
from shelfscan.session import written


def own(files: DataFrame) -> DataFrame:
    return files.select(*(c for c in files.columns if c in FILE_COLUMNS))


def scoped(files: DataFrame, under: str | None = None, exts: list[str] | None = None) -> DataFrame:
    files = own(files)
    if under:
        files = files.where(within(F.col("path"), under))
    return files.where(F.col("ext").isin(["." + e.lstrip(".").lower() for e in exts])) if exts else files


def by_name(files: DataFrame, limit: int = 0, exts: list[str] | None = None) -> DataFrame:
    """name, size, copies, path, mtime of files with one name (case matters) and size above 0; the limit counts rows. Nulls are no name or size.

    The sets are an aggregate with map-side combine; rows of sets come from a join with them.
    """
    rows = scoped(files.where((F.col("is_dir") == 0) & (F.col("size") > 0)), exts=exts)
    sets = rows.groupBy("name", "size").agg(F.count("*").alias("copies")).where("copies > 1")
    out = rows.join(sets, ["name", "size"]).select("name", "size", "copies", "path", "mtime").orderBy(F.desc("size"), "name", "path")
    return out.limit(limit) if limit > 0 else out


def by_name_summary(files: DataFrame) -> DataFrame:
    """groups, files, wasted (the size of all copies but one)."""
    sets = files.where((F.col("is_dir") == 0) & (F.col("size") > 0)).groupBy("name", "size").agg(F.count("*").alias("n")).where("n > 1")
    return sets.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("wasted"))


def by_content(files: DataFrame, limit: int = 0, exts: list[str] | None = None, under: str | None = None) -> DataFrame:
    """path, size, mtime, copies, fhash of files with one full hash. Copies are counted everywhere, a scope only picks the rows shown, so a
    set may show one; the limit counts rows."""
    sets = files.where((F.col("is_dir") == 0) & F.col("fhash").isNotNull() & (F.col("size") > 0)).groupBy("fhash").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = scoped(files.where(F.col("is_dir") == 0), under, exts).join(sets, "fhash")
    out = rows.select("path", "size", "mtime", "copies", "fhash").orderBy(F.desc("size"), "fhash", "path")
    return out.limit(limit) if limit > 0 else out


def by_content_summary(files: DataFrame, exts: list[str] | None = None, under: str | None = None) -> DataFrame:
    """groups, files, wasted within the scope; of a set's sizes the largest counts (equal content has one)."""
    rows = scoped(files.where((F.col("is_dir") == 0) & F.col("fhash").isNotNull() & (F.col("size") > 0)), under, exts)
    sets = rows.groupBy("fhash").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1")
    return sets.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("wasted"))


def content_sets(files: DataFrame) -> DataFrame:
    """set, files, path, size, mtime of sets of one content, the largest first."""
    rows = by_content(files)
    sets = rows.groupBy("fhash").agg(F.max("size").alias("big"))
    return rows.join(numbered(sets, [F.desc("big"), F.asc("fhash")], "set").select("fhash", F.col("set").cast("int").alias("set")), "fhash").select("set", F.col("copies").alias("files"), "path", "size", "mtime")


def name_sets(files: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """set, files, path, size, mtime of sets of one name and size, the largest first."""
    rows = by_name(files, 0, exts)
    sets = numbered(rows.select("name", "size").distinct(), [F.desc("size"), F.asc("name")], "set")
    return rows.join(sets, ["name", "size"]).select(F.col("set").cast("int").alias("set"), F.col("copies").alias("files"), "path", "size", "mtime")


def combined(files: DataFrame) -> DataFrame:
    """set, match, path, size, mtime of all three kinds; each kind's numbers follow the last of the one before."""
    out, last = None, 0
    for label, kind in (("identical", content_sets), ("near-text", near_texts), ("similar-image", near_images)):
        rows = written(kind(files), "sets")
        part = rows.select((F.col("set") + last).cast("int").alias("set"), F.lit(label).alias("match"), "path", "size", "mtime")
        last += rows.agg(F.coalesce(F.max("set"), F.lit(0))).collect()[0][0]
        out = part if out is None else out.unionByName(part)
    return out


def first_sets(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of the first sets; a limit of likeness counts sets, 0 is all."""
    return rows.where(F.col("set") <= limit) if limit > 0 else rows


def to_remove(rows: DataFrame, keep: str, key: str = "set") -> DataFrame:
    """All rows of a set but the newest, the oldest or the first by path (ties by path; a null mtime is the oldest).

    The kept row is found by an aggregate of structs with map-side combine and joined away, so a set of any size moves one row a task.
    """
    at = F.coalesce("mtime", F.lit(float("-inf")))
    best = {"newest": F.min(F.struct((-at).alias("a"), "path")), "oldest": F.min(F.struct(at.alias("a"), "path")), "first": F.min(F.struct("path"))}[keep]
    kept = rows.groupBy(key).agg(best.alias("x")).select(key, F.col("x.path").alias("path"))
    return rows.join(kept, [key, "path"], "left_anti")


def under(rows: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Sets within a folder: rows beneath it, of sets that still have two."""
    rows = rows.where(within(F.col("path"), folder))
    sets = rows.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").select(*key)
    return rows.join(sets, key, "left_semi")


def hash_candidates(files: DataFrame, mode: str, scope: str | None = None, exts: list[str] | None = None) -> DataFrame:
    """id, path, size of the files a hashing stage must read: all (no partial hash), full (no full hash), size (no partial hash
    and another file of its size) or partial (no full hash and another of its size and partial hash); collisions count everywhere."""
    real = files.where((F.col("is_dir") == 0) & (F.col("size") > 0))
    rows = scoped(real, scope, exts)
    if mode == "all":
        rows = rows.where(F.col("phash").isNull())
    elif mode == "full":
        rows = rows.where(F.col("fhash").isNull())
    elif mode == "size":
        sizes = real.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
        rows = rows.where(F.col("phash").isNull()).join(sizes, "size", "left_semi")
    elif mode == "partial":
        both = files.where((F.col("is_dir") == 0) & F.col("phash").isNotNull()).groupBy("size", "phash").agg(F.count("*").alias("n")).where("n > 1").select("size", "phash")
        rows = rows.where(F.col("fhash").isNull() & F.col("phash").isNotNull()).join(both, ["size", "phash"], "left_semi")
    else:
        raise ValueError(mode)
    return rows.select("id", "path", "size")
