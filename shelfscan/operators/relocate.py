"""Roots whose drive moved: planned, applied, described. Mounts come as a table (volume_id, mount, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.operators.roots import with_root


def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]+$", "")


def prefix(path: Column) -> Column:
    return F.concat(bare(path), F.when(path.contains("\\"), F.lit("\\")).otherwise(F.lit("/")))


def _plain(path: Column) -> Column:
    """A path to compare: no separator at its end, and one kind of them, so that `D:` needs none of its own."""
    return F.translate(bare(path), "\\", "/")


def _norm(path: Column) -> Column:
    return F.when(path.contains("\\"), F.lower(bare(path))).otherwise(bare(path))


def located(roots: DataFrame, mounts: DataFrame, present: DataFrame) -> DataFrame:
    """roots with here (the path is there: present(path)), now_id (the volume it now lies on) and where its own volume is mounted."""
    m = mounts.where(F.col("volume_id").isNotNull())
    own = m.groupBy("volume_id").agg(F.min(F.struct("mount", "label")).alias("own"))
    under = with_root(roots.withColumn("__p", F.concat(_plain(F.col("path")), F.lit("/"))), m.select(_plain(F.col("mount")).alias("path")), "__p", "now_mount")
    volume = m.groupBy(_plain(F.col("mount")).alias("now_mount")).agg(F.min("volume_id").alias("now_id"))
    here = present.where(F.col("path").isNotNull()).select("path").distinct().withColumn("here", F.lit(True))
    return under.join(here, "path", "left").join(volume, "now_mount", "left").join(own, "volume_id", "left").withColumn("here", F.coalesce("here", F.lit(False))).drop("__p")


def plan(roots: DataFrame, mounts: DataFrame, present: DataFrame) -> DataFrame:
    """path, state (ok, moved, away, missing), new_path of each root: moved if its volume is mounted elsewhere, away if another volume is in
    its place, missing if nowhere. A root without a volume is ok or missing."""
    x = located(roots, mounts, present)
    new_mount, base = F.col("own.mount"), F.col("mount")
    same = F.col("here") & (F.col("now_id").isNull() | (F.col("now_id") == F.col("volume_id")))
    absent = F.when(F.col("here"), "away").otherwise("missing")
    state = (
        F.when(F.col("volume_id").isNull(), F.when(F.col("here"), "ok").otherwise("missing"))
        .when(same, "ok")
        .when(F.col("own").isNull(), absent)
        .when(base.isNull() | (_norm(new_mount) == _norm(base)), "missing")
        .otherwise("moved")
    )
    rest = F.regexp_replace(F.substr(F.col("path"), F.length(bare(base)) + 1), r"^[/\\]+", "")
    target = F.when(rest == "", new_mount).otherwise(F.concat(prefix(new_mount), rest))
    return x.withColumn("state", state).select("path", "state", F.when(F.col("state") == "moved", target).alias("new_path"))


def describe(roots: DataFrame, mounts: DataFrame, present: DataFrame) -> DataFrame:
    """path, last_index, label, state: ok, not connected, connected elsewhere or different drive here."""
    x = located(roots, mounts, present)
    state = (
        F.when(F.col("here") & (F.col("volume_id").isNull() | F.col("now_id").isNull() | (F.col("now_id") == F.col("volume_id"))), "ok")
        .when(F.col("here"), "different drive here")
        .when(F.col("volume_id").isNotNull() & F.col("own").isNotNull(), "connected elsewhere")
        .otherwise("not connected")
    )
    return x.select("path", "last_index", F.coalesce("volume_label", F.lit("")).alias("label"), state.alias("state"))


def stamp(roots: DataFrame, mounts: DataFrame, present: DataFrame, force: bool = False) -> DataFrame:
    """roots with the volume that each present one lies on; one stamped with another volume stays, unless forced."""
    x = located(roots, mounts, present)
    label = mounts.groupBy(F.col("volume_id").alias("now_id")).agg(F.min(F.struct("mount", "label")).alias("now"))
    take = F.col("here") & F.col("now_id").isNotNull() & (F.col("volume_id").isNull() | (F.col("volume_id") == F.col("now_id")) | F.lit(force))
    y = x.join(label, "now_id", "left")
    new = {"volume_id": F.col("now_id"), "volume_label": F.col("now.label"), "mount": F.col("now.mount")}
    return y.select(*(F.when(take, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in roots.columns))


def restamp(roots: DataFrame, mounts: DataFrame, moved: DataFrame) -> DataFrame:
    """roots with the mount and label their volume now has, of those that moved(new_path): what a root is cut by at its next move."""
    own = mounts.where(F.col("volume_id").isNotNull()).groupBy("volume_id").agg(F.min(F.struct("mount", "label")).alias("__own"))
    here = moved.where(F.col("new_path").isNotNull()).select(F.col("new_path").alias("path"), F.lit(True).alias("__moved")).distinct()
    x = roots.join(here, "path", "left").join(own, "volume_id", "left")
    new = F.coalesce(F.col("__moved"), F.lit(False)) & F.col("__own").isNotNull()
    value = {"mount": F.when(new, F.col("__own.mount")).otherwise(F.col("mount")), "volume_label": F.when(new, F.col("__own.label")).otherwise(F.col("volume_label"))}
    return x.select(*(value[c].alias(c) if c in value else F.col(c) for c in roots.columns))


def swap(plan: DataFrame) -> DataFrame:
    """path, new_path of moved roots whose destination is another moved root's place: those must be moved at once, as move() does."""
    moved = plan.where("state = 'moved'").select("path", "new_path")
    return moved.join(moved.select(F.col("path").alias("new_path")), "new_path", "left_semi").select("path", "new_path")


def move(rows: DataFrame, moves: DataFrame, column: str = "path") -> DataFrame:
    """rows with every path at or beneath moves.path rewritten to moves.new_path, all at once (two that swap places need no third), and the rows
    dropped that stood at or beneath a destination and did not move themselves. Compared exactly; the longest source wins."""
    src = moves.where(F.col("new_path").isNotNull()).select(_plain(F.col("path")).alias("path"), bare(F.col("new_path")).alias("new_path"))
    keyed = rows.withColumn("__p", F.concat(_plain(F.col(column)), F.lit("/")))
    keyed = with_root(with_root(keyed, src.select("path"), "__p", "__from"), src.select(_plain(F.col("new_path")).alias("path")), "__p", "__stale")
    to = src.select(F.col("path").alias("__from"), F.col("new_path").alias("__to"))
    joined = keyed.where(F.col("__from").isNotNull() | F.col("__stale").isNull()).join(to, "__from", "left")
    rest = F.substr(F.col(column), F.length("__from") + 1)
    kept = F.when(F.col("__to").isNull(), F.col(column)).when(rest == "", F.col("__to")).otherwise(F.concat(F.col("__to"), F.when(F.col("__to").rlike(r"^[A-Za-z]:|\\\\"), "\\").otherwise("/"), F.substr(rest, F.lit(2))))
    return joined.withColumn(column, kept).select(*rows.columns)


def translate(roots: list[str], moves: dict[str, str]) -> list[str]:
    """The roots a caller named, with those that moved replaced; drives and shares compared without case."""
    norm = lambda p: (p.lower() if "\\" in p else p).rstrip("/\\")
    to = {norm(a): b for a, b in moves.items()}
    return [to.get(norm(r), r) for r in roots]
