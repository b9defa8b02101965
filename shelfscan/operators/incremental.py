"""The index kept in step with what a walk saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.constants import AUDIO_EXTS, CLOUD_MASK, IMAGE_EXTS, INDEXABLE_EXTS, MAX_FILE_BYTES, OCR_FEW_CHARS
from shelfscan.functions.strings import ascii_lower
from shelfscan.operators.roots import with_root
from shelfscan.session import written

SAME_MTIME = 1e-6
FINGERPRINTS = ("phash", "fhash", "kind", "dhash")


def is_cloud(attributes: Column) -> Column:
    """Whether a file's attributes mark it as a placeholder kept elsewhere."""
    return attributes.bitwiseAND(F.lit(CLOUD_MASK)) != 0


def wants_text(exts: list[str] = INDEXABLE_EXTS, include_cloud: bool = False) -> Column:
    """A row of a walk whose text is to be read: a type that can be, not too big (audio may be), here or asked for."""
    small = (F.col("size") <= MAX_FILE_BYTES) | F.col("ext").isin(AUDIO_EXTS)
    here = F.lit(True) if include_cloud else F.col("is_cloud") == 0
    return F.coalesce((F.col("is_dir") == 0) & F.col("ext").isin(exts) & small & here, F.lit(False))


def retry(ocr: bool = False) -> Column:
    """A files row to be read again though unchanged: an error that was not the extractor's own end, or with recognition on a
    scan or picture of few characters not yet recognised."""
    failed = (F.col("status") == "error") & ~F.coalesce(F.col("error").startswith("extractor "), F.lit(False))
    if not ocr:
        return F.coalesce(failed, F.lit(False))
    few = F.col("status").isin("ok", "empty") & (F.coalesce("chars", F.lit(0)) < OCR_FEW_CHARS) & ~F.coalesce(F.col("error") == "ocr", F.lit(False))
    return F.coalesce(failed, F.lit(False)) | F.coalesce(few & F.col("ext").isin([".pdf", *IMAGE_EXTS]), F.lit(False))


def known_state(files: DataFrame, ocr: bool = False) -> DataFrame:
    """id, path, size, mtime, status, retry of the index."""
    return files.select("id", "path", "size", "mtime", "status", retry(ocr).alias("retry"))


def classify(walk: DataFrame, files: DataFrame, rebuild: bool = False, ocr: bool = False, stale_exts: list[str] | None = None) -> DataFrame:
    """path, action of every path of the walk or the index: new, changed, unchanged, newly-eligible (now its text is wanted), retry, stale
    (its extractor got better), or unseen. Paths are compared exactly; null paths are left out; a path seen twice counts as its largest
    row. Null sizes or mtimes on both sides are the same. One full outer join by path."""
    seen = (
        walk.where(F.col("path").isNotNull())
        .withColumn("wants", wants_text())
        .groupBy("path")
        .agg(F.max(F.struct("size", "mtime", "ext", "wants")).alias("s"))
    )
    known = known_state(files.where(F.col("path").isNotNull()), ocr).groupBy("path").agg(F.max(F.struct("id", "size", "mtime", "status", "retry")).alias("k"))
    same = F.col("s.size").eqNullSafe(F.col("k.size")) & (
        (F.col("s.mtime").isNull() & F.col("k.mtime").isNull()) | F.coalesce(F.abs(F.col("s.mtime") - F.col("k.mtime")) < SAME_MTIME, F.lit(False))
    )
    stale = F.col("s.ext").isin(stale_exts) if stale_exts else F.lit(False)
    action = (
        F.when(F.col("s").isNull(), "unseen")
        .when(F.col("k").isNull(), "new")
        .when(F.lit(rebuild) | ~same, "changed")
        .when(F.col("s.wants") & F.coalesce(F.col("k.status") == "listed", F.lit(False)), "newly-eligible")
        .when(F.col("s.wants") & F.col("k.retry"), "retry")
        .when(F.col("s.wants") & stale, "stale")
        .otherwise("unchanged")
    )
    return seen.join(known, "path", "full_outer").select("path", action.alias("action"))


def upsert(files: DataFrame, rows: DataFrame) -> DataFrame:
    """files with rows (path, name, ext, size, mtime, indexed, chars, status, error, is_dir) written over it by path. What describes the bytes
    (FINGERPRINTS) stays only if size and mtime are equal, simhash only if chars are too; name and ext of a known path stay. New paths get ids
    after the largest; of several rows of a path the last indexed counts. One full outer join by path."""
    from shelfscan.operators.similarity import numbered

    fresh = [c for c in rows.columns if c != "path"]
    new = rows.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("indexed", *[c for c in fresh if c != "indexed"])).alias("__row"))
    # read twice below (the new paths are numbered), so written once
    joined = written(files.withColumn("__known", F.lit(True)).join(new, "path", "full_outer"), "joined")
    hit, known = F.col("__row").isNotNull(), F.col("__known").isNotNull()
    bytes_same = (F.col("size") == F.col("__row.size")) & (F.col("mtime") == F.col("__row.mtime"))
    text_same = bytes_same & (F.col("chars") == F.col("__row.chars"))

    def value(c: str) -> Column:
        if c in ("name", "ext"):
            return F.when(known, F.col(c)).otherwise(F.col(f"__row.{c}"))
        if c in fresh:
            return F.when(hit, F.col(f"__row.{c}")).otherwise(F.col(c))
        if c in FINGERPRINTS:
            return F.when(~hit | bytes_same, F.col(c))
        return F.when(~hit | text_same, F.col(c)) if c == "simhash" else F.col(c)

    rest = [value(c).alias(c) for c in files.columns if c not in ("path", "id")]
    top = joined.agg(F.coalesce(F.max("id"), F.lit(0))).collect()[0][0]
    added = numbered(joined.where(~known).select("path", *rest), [F.asc("path")], "__new")
    old = joined.where(known).select("id", "path", *rest)
    return old.unionByName(added.select((F.col("__new") + F.lit(top)).alias("id"), "path", *(c for c in files.columns if c not in ("path", "id")))).select(*files.columns)


def name_only(walk: DataFrame, indexed: float) -> DataFrame:
    """Rows of a walk as entries without text."""
    folder = F.col("is_dir") == 1
    return walk.select("path", "name", "ext", "size", "mtime", F.lit(indexed).alias("indexed"), F.lit(0).cast("bigint").alias("chars"), F.when(folder, "folder").otherwise("listed").alias("status"), F.lit("").alias("error"), "is_dir")


def vanished(files: DataFrame, walk: DataFrame, roots: DataFrame, blind: DataFrame | None = None) -> DataFrame:
    """files rows the walk did not see, beneath a walked root (roots(path)) and not beneath a folder that could not be listed (blind(path))."""
    gone = files.join(walk.where(F.col("path").isNotNull()).select("path").distinct(), "path", "left_anti")
    gone = with_root(gone, roots, "path", "__root").where(F.col("__root").isNotNull()).drop("__root")
    if blind is not None:
        gone = with_root(gone, blind, "path", "__blind").where(F.col("__blind").isNull()).drop("__blind")
    return gone


def prune(files: DataFrame, walk: DataFrame, roots: DataFrame, blind: DataFrame | None = None) -> DataFrame:
    return files.join(vanished(files, walk, roots, blind).select("path"), "path", "left_anti")


def forget(files: DataFrame, paths: DataFrame) -> DataFrame:
    """files without these paths and without what is beneath those that are folders."""
    named = files.join(paths.where(F.col("path").isNotNull()).select("path").distinct(), "path", "left_semi")
    folders = named.where(F.col("is_dir") == 1).select("path")
    left = with_root(files.join(named.select("path"), "path", "left_anti"), folders, "path", "__in")
    return left.where(F.col("__in").isNull()).drop("__in")


def run_stats(actions: DataFrame) -> DataFrame:
    """action, n."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def denest(roots: DataFrame) -> DataFrame:
    """path of the roots that lie under no other, A to Z compared without case; equal ones once, the smallest spelling."""
    key = roots.where(F.col("path").isNotNull()).groupBy(ascii_lower(F.regexp_replace("path", r"(?<=.)[/\\]+$", "")).alias("k")).agg(F.min("path").alias("path"))
    return with_root(key, key.select(F.col("k").alias("path")), "k", "__in").where(F.col("__in").isNull()).select("path")


def merge_roots(roots: DataFrame, walked: DataFrame, now: float, indexed: bool) -> DataFrame:
    """roots with the walked paths remembered: new ones added now; last_index is set only by an indexing run."""
    w = walked.where(F.col("path").isNotNull()).select("path").distinct().withColumn("__w", F.lit(True))
    joined = roots.join(w, "path", "full_outer")
    stamp = F.lit(now) if indexed else F.lit(None).cast("double")
    last = F.when(F.col("__w") & F.lit(indexed), F.lit(now)).otherwise(F.when(F.col("added").isNull(), stamp).otherwise(F.col("last_index")))
    return joined.select("path", F.coalesce("added", F.lit(now)).alias("added"), last.alias("last_index"), *[c for c in roots.columns if c not in ("path", "added", "last_index")])


def set_roots(roots: DataFrame, paths: DataFrame, now: float) -> DataFrame:
    """roots made exactly these paths; those already there keep their dates."""
    return merge_roots(roots.join(paths.select("path").distinct(), "path", "left_semi"), paths, now, indexed=False)
