"""Figures of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.constants import TYPE_GROUPS


def totals(files: DataFrame) -> DataFrame:
    """total, chars, folders; 0 where there is nothing."""
    return files.agg(F.count("*").alias("total"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if(F.col("is_dir") == 1).alias("folders"))


def header(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("is_dir") == 1).alias("folders"))


def by_status(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def top_extensions(files: DataFrame, k: int = 15) -> DataFrame:
    """ext, n, chars of the most frequent types of files."""
    rows = files.where(F.col("is_dir") == 0).groupBy("ext").agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    return rows.orderBy(F.desc("n"), "ext").limit(k)


def errors(files: DataFrame, k: int = 10) -> DataFrame:
    """n (all errors), path, error of the first k."""
    bad = files.where(F.col("status") == "error")
    n = bad.count()
    return bad.orderBy("path").limit(k).select(F.lit(n).cast("bigint").alias("n"), "path", "error")


def type_counts(files: DataFrame, k: int = 500) -> DataFrame:
    """kind, name, n: the k most frequent extensions, the families over them, and folders."""
    exts = files.where((F.col("is_dir") == 0) & (F.col("ext") != "")).groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(k)
    family = files.sparkSession.createDataFrame([(g, e) for g, members in TYPE_GROUPS.items() for e in members], "name string, ext string")
    folders = files.agg(F.count_if(F.col("is_dir") == 1).alias("n")).select(F.lit("folders").alias("kind"), F.lit("folders").alias("name"), "n")
    sums = exts.join(F.broadcast(family), "ext").groupBy("name").agg(F.sum("n").alias("n")).select(F.lit("family").alias("kind"), "name", "n")
    return exts.select(F.lit("ext").alias("kind"), F.col("ext").alias("name"), "n").union(sums).union(folders)
