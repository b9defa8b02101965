"""The test tables made odd: empty, all null, or with more columns whose names clash with ours."""

from pathlib import Path

from pyspark.sql import functions as F

DATA = Path("/root/testdata/sf0.001")
CLASHES = ["n", "g", "v", "w", "t", "x", "k", "at", "id_a", "rep", "label", "root", "key", "block", "word", "set", "place", "found", "score", "term", "length", "action", "new", "copies", "files", "wasted", "folders", "big", "label", "h", "a", "b"]


def make(spark, folder: Path, kind: str) -> str:
    out = folder / kind
    for p in DATA.glob("*.parquet"):
        df = spark.read.parquet(str(p))
        if kind == "empty":
            df = df.limit(0)
        elif kind == "null":
            # a few rows of nothing at all, and the table's own
            nothing = spark.range(3).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
            df = df.limit(0).union(nothing)
        else:
            have = {c.lower() for c in df.columns}
            df = df.select("*", *(F.lit(f"clash {c}").alias(c) for c in dict.fromkeys(CLASHES) if c not in have))
        df.coalesce(1).write.parquet(str(out / p.name))
    return str(out)


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
