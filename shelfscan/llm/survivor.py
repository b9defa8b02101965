"""Best representative of each group of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.operators.roots import with_root

#: An mtime before 1980-01-01 is no usable one.
FIRST_MTIME = 315532800


def survivors(files: DataFrame, roots: DataFrame) -> DataFrame:
    """group_id, keep_id of each group of two or more files (is_dir = 0) with one non-null fhash, letter case ignored.

    group_id is the smallest id. The kept row is the first by trust (its path under a registered root), completeness
    (size above 0), recency (usable mtime, the later first; all unusable ones are equal), then id. Rows without id or
    fhash take no part; nulls in path, size, mtime or indexed only make a row worse; repeated rows of one id count
    once; empty tables give no rows; other columns are ignored.

    The ranking is a window with row_number() = 1, which Spark cuts to one row a group in every map task before the
    shuffle (WindowGroupLimit), so a group with a third of all rows moves one row a task; the group's size and
    smallest id are a separate aggregate with map-side combine.
    """
    rows = with_root(
        files.where((F.col("is_dir") == 0) & F.col("fhash").isNotNull() & F.col("id").isNotNull())
        .select(F.lower("fhash").alias("g"), "id", "path", "size", "mtime", "indexed"),
        roots, "path", "root",
    )
    usable = F.coalesce((F.col("mtime") >= FIRST_MTIME) & (F.col("mtime") <= F.col("indexed")), F.lit(False))
    ranked = rows.select(
        "g", "id",
        F.col("root").isNull().alias("untrusted"),
        (~F.coalesce(F.col("size") > 0, F.lit(False))).alias("incomplete"),
        F.when(usable, F.col("mtime")).alias("at"),
    )
    order = Window.partitionBy("g").orderBy("untrusted", "incomplete", F.col("at").desc_nulls_last(), "id")
    kept = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).select("g", F.col("id").alias("keep_id"))
    groups = ranked.groupBy("g").agg(F.min("id").alias("group_id"), F.max("id").alias("last")).where(F.col("group_id") < F.col("last"))
    return groups.join(kept, "g").select("group_id", "keep_id")
