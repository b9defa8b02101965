"""Fingerprints that differ in few bits: banded pairs and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.constants import DHASH_FLAT_BITS, DHASH_NONE, IMAGE_DISTANCE, NEAR_DISTANCE
from shelfscan.operators.connect import connected
from shelfscan.session import written


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_count(distance: int) -> int:
    """Four bands of 16 bits up to three bits' distance, else eight of 8: two that differ in fewer bits than there are bands share one."""
    return 4 if distance <= 3 else 8


#: Distinct fingerprints of a band's bucket that meet in one block; larger buckets are split.
BLOCK = 2000


def banded_pairs(rows: DataFrame, distance: int, hot_bucket: int | None = None) -> DataFrame:
    """v, w: fingerprints v < w of rows(v) that share a band's bits and differ in at most `distance` bits.

    Equal fingerprints are one row. A bucket of more than BLOCK distinct ones is cut into blocks by hash and every pair of blocks meets, each in a
    key of its own: exact, and no key holds more than about two blocks. With hot_bucket, buckets of more rows than that are passed over,
    as the reference does. Null fingerprints take no part.
    """
    bands = band_count(distance)
    width = 64 // bands
    counted = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    cut = counted.select("v", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("v", k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for k in range(bands)))).alias("b"))
    cut = cut.select("v", "n", "b.band", "b.key")
    usable = cut.groupBy("band", "key").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds")).where(F.col("kinds") > 1)
    usable = usable.where(F.col("rows") <= hot_bucket) if hot_bucket else usable
    usable = usable.select("band", "key", F.ceil(F.col("kinds") / F.lit(BLOCK)).cast("int").alias("blocks"))
    kept = cut.select("v", "band", "key").join(usable, ["band", "key"]).withColumn("at", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    # block i meets block j in (i, j), i <= j: a row of block b is in (b, j) as the first and in (i, b) as the second
    first = kept.select("band", "key", F.col("at").alias("i"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("j"), "v")
    second = kept.select("band", "key", F.explode(F.expr("sequence(0, at)")).alias("i"), F.col("at").alias("j"), F.col("v").alias("w"))
    met = first.join(second, ["band", "key", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("v") < F.col("w"))) & (hamming(F.col("v"), F.col("w")) <= distance))
    return met.select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w")).distinct()


def groups(rows: DataFrame, distance: int, hot_bucket: int | None = None) -> DataFrame:
    """rows with column label of those rows(v, ...) in a group of two or more rows with like fingerprints, directly or
    through others. Rows of equal fingerprints are like without a band; a class of copies stays one vertex."""
    linked = connected(banded_pairs(rows, distance, hot_bucket))
    sizes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    labels = linked.union(sizes.join(linked, "v", "left_anti").select("v", F.col("v").alias("label")))
    return rows.join(labels, "v")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with column `name`, 1 and up in the given order, without a single-task sort: rows are range partitioned and
    sorted, and each partition's offset is the count of those before it (a number a partition reaches the driver)."""
    at = "__at"
    held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = sorted((r[0], r[1]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 1
    for p, n in counts:
        offsets.append((p, total))
        total += n
    first = held.sparkSession.createDataFrame(offsets, "__p bigint, __first bigint")
    number = (F.col("__first") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")
    return held.withColumn("__p", part).join(F.broadcast(first), "__p").withColumn(name, number).drop("__p", "__first", at)


def _numbered(members: DataFrame) -> DataFrame:
    """Sets in order: the most files first, then the largest file first (ties: the first path). set counts from 1."""
    per = members.groupBy("label").agg(F.count("*").alias("files"), F.max(F.coalesce("size", F.lit(0))).alias("big"), F.min("path").alias("first"))
    order = numbered(per, [F.desc("files"), F.desc("big"), F.asc("first")], "set").select("label", "files", F.col("set").cast("int").alias("set"))
    return members.join(order, "label").drop("label")


def near_texts(files: DataFrame, distance: int = NEAR_DISTANCE, under: str | None = None, hot_bucket: int | None = None) -> DataFrame:
    """set, files, path, size, mtime of texts whose simhashes are like; with hot_bucket (the reference: HOT_BUCKET) buckets of more rows are passed over."""
    from shelfscan.functions.strings import within

    rows = files.where((F.col("is_dir") == 0) & F.col("simhash").isNotNull())
    rows = rows.where(within(F.col("path"), under)) if under else rows
    return _numbered(groups(rows.select(F.col("simhash").alias("v"), "path", "size", "mtime"), distance, hot_bucket)).select("set", "files", "path", "size", "mtime")


def near_images(files: DataFrame, distance: int = IMAGE_DISTANCE, under: str | None = None, hot_bucket: int | None = None) -> DataFrame:
    """The same of images; undecodable and featureless ones (at most DHASH_FLAT_BITS ones or zeros) take no part."""
    from shelfscan.functions.strings import within

    ones = F.bit_count("dhash")
    rows = files.where((F.col("is_dir") == 0) & (F.col("dhash") != DHASH_NONE) & (ones > DHASH_FLAT_BITS) & (ones < 64 - DHASH_FLAT_BITS))
    rows = rows.where(within(F.col("path"), under)) if under else rows
    return _numbered(groups(rows.select(F.col("dhash").alias("v"), "path", "size", "mtime"), distance, hot_bucket)).select("set", "files", "path", "size", "mtime")
