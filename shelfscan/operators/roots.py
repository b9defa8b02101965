"""Which registered root a path lies under."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many roots their paths become literals of one expression (no join at all).
LITERAL_ROOTS = 64


def root_key(path: Column) -> Column:
    """The root's path followed by its separator: `\\` if the path holds one, else `/`."""
    return F.concat(path, F.when(path.contains("\\"), F.lit("\\")).otherwise(F.lit("/")))


def with_root(df: DataFrame, roots: DataFrame, path: str, out: str, literal_roots: int = LITERAL_ROOTS) -> DataFrame:
    """df with column `out`: the path of the root that the row's path lies under, else null.

    A path lies under a root if it begins with root_key(root), compared exactly; of nested roots the
    longest wins. Null paths lie under none; null roots are ignored; repeated roots count once.
    A small register (checked by reading one row more than the limit) becomes literals; a larger one is
    joined on the ancestors of each distinct path, an equi-join that Spark may shuffle.
    """
    own = roots.where(F.col("path").isNotNull()).select(F.col("path").alias("__root")).distinct()
    few = own.limit(literal_roots + 1).collect()
    if len(few) <= literal_roots:
        ordered = sorted((r[0] for r in few), key=lambda p: (-len(p), p))
        sep = lambda p: "\\" if "\\" in p else "/"
        hits = [F.when(F.col(path).startswith(p + sep(p)), F.lit(p)) for p in ordered]
        return df.withColumn(out, F.coalesce(*hits) if hits else F.lit(None).cast("string"))
    cuts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)).isin("/", "\\"))
    found = (
        df.where(F.col(path).isNotNull())
        .select(path)
        .distinct()
        .select(path, F.explode(F.when(F.length(path) > 0, cuts)).alias("__at"))
        .select(path, F.substring(path, F.lit(1), F.col("__at")).alias("__key"))
        .join(own.withColumn("__key", root_key(F.col("__root"))), "__key")
        .groupBy(F.col(path).alias("__path"))
        .agg(F.max_by("__root", F.length("__root")).alias(out))
    )
    return df.join(found, F.col(path) == F.col("__path"), "left").drop("__path")


def under_any(path: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes], F.lit(False))
