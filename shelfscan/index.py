"""An index in a folder: everything the engine does, by the names of its commands."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.functions.constants import EXTRACT_VERSION, IMAGE_EXTS, INDEXABLE_EXTS, REEXTRACT_EXTS
from shelfscan.operators import dupes, fingerprint, fts, incremental, relocate, similarity, stats, tree
from shelfscan.operators.roots import with_root
from shelfscan.plans import search
from shelfscan.plans.query import Clock
from shelfscan.session import scratch, written
from shelfscan.sources import extract, sinks, volumes, walk

FILES = "id bigint, path string, name string, ext string, size bigint, mtime double, indexed double, chars bigint, status string, error string, is_dir int, phash string, fhash string, kind string, simhash bigint, dhash bigint"
DOCS = "id bigint, body string"
ROOTS = "path string, added double, last_index double, volume_id string, volume_label string, mount string"
SCHEMAS = {"files": FILES, "docs": DOCS, "roots": ROOTS}


POSTINGS = "term string, id bigint, at array<int>, length int, gen bigint"
CURRENT = "id bigint, length int, gen bigint"
GRAMS = "id bigint, gram string"
STORED = {"postings": POSTINGS, "current": CURRENT, "grams": GRAMS}
#: How the tables are sorted where they are written, so that a filter reads few row groups.
SORTED = {"postings": ["term"], "grams": ["gram"]}


class Index:
    """Tables files, docs and roots, what is searched by (postings, current, grams) and meta in `folder`, which all executors see. A run publishes all it changed
    at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.local = "://" not in folder or folder.startswith("file://")
        self.store = sinks.Store(spark, folder if "://" in folder else f"file://{os.path.abspath(folder)}")

    def locked(self):
        """Held by one run at a time, on the file system that the index is on."""
        if not self.local:
            return sinks.SharedLock(self.spark, f"{self.folder}/run.lock")
        folder = self.store.folder.removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        return sinks.RunLock(os.path.join(folder, "run.lock"))

    def table(self, name: str) -> DataFrame:
        """A table as of now; empty if it was never written. Columns that older versions lack are null."""
        empty = self.spark.createDataFrame([], (SCHEMAS | STORED)[name])
        if not self.store.has(name):
            return empty
        return empty.unionByName(self.store.read(name), allowMissingColumns=True).select(*empty.columns)

    files = property(lambda self: self.table("files"))
    docs = property(lambda self: self.table("docs"))
    roots = property(lambda self: self.table("roots"))

    @property
    def stored(self) -> fts.Stored | None:
        """The postings, read as they lie so that conditions reach the scan; None before the first run."""
        return fts.Stored(self.store.read("postings"), self.store.read("current")) if self.store.has("postings") and self.store.has("current") else None

    def refresh(self, folders: list[str] | None = None, rebuild: bool = False, include_cloud: bool = False, recognition: bool = False, now: float | None = None, mounts: DataFrame | None = None) -> dict[str, int]:
        """Walks the folders (or the remembered roots), reads what is new, changed or due, drops what is gone; the number of paths of each action.

        Drives that moved are followed first, and roots in whose place another drive is mounted are left out. Only what changed is read; all tables are
        published at once, so readers and a failed run keep the old ones.
        """
        now = time.time() if now is None else now
        with self.locked(), scratch(self.spark):
            away = self._follow(volumes.mounts(self.spark) if mounts is None else mounts)
            named = [os.path.abspath(f) for f in folders] if folders else [r["path"] for r in self.roots.select("path").collect()]
            named = [f for f in named if os.path.isdir(f) and f not in away]
            seen = written(walk.walk(self.spark, named), "walk")
            listed = seen.where("listed = 1")
            walked = self.spark.createDataFrame([(f,) for f in named], "path string")
            old = self.files
            actions = written(self._actions(listed, old, named, rebuild, recognition), "actions")
            work = listed.join(actions.where("action NOT IN ('unchanged', 'unseen')"), "path", "left_semi")
            gone = incremental.vanished(old, listed, walked, seen.where("listed = 0").select("path")).select("path")
            meta = {f"extract_version:{f}": str(EXTRACT_VERSION) for f in named} | ({} if folders else {"extract_version": str(EXTRACT_VERSION)})
            roots = incremental.merge_roots(self.roots, walked, now, indexed=True)
            self._take_in(work, gone, now, include_cloud, recognition, meta, written(roots, "roots"))
            return {r["action"]: r["n"] for r in incremental.run_stats(actions).collect()}

    def _actions(self, listed: DataFrame, old: DataFrame, named: list[str], rebuild: bool, recognition: bool) -> DataFrame:
        """What each path calls for. A root last read by an older extractor has its files of the types that got better read again."""
        meta = self.store.manifest()[1]["meta"]
        version = lambda f: max(int(meta.get("extract_version", 0)), int(meta.get(f"extract_version:{f}", 0)))
        stale = [f for f in named if 0 < version(f) < EXTRACT_VERSION]
        if not stale:
            return incremental.classify(listed, old, rebuild, recognition)
        out = incremental.classify(listed, old, rebuild, recognition, REEXTRACT_EXTS)
        out = with_root(out, self.spark.createDataFrame([(f,) for f in stale], "path string"), "path", "__stale")
        return out.select("path", F.when((F.col("action") == "stale") & F.col("__stale").isNull(), "unchanged").otherwise(F.col("action")).alias("action"))

    def _take_in(self, work: DataFrame, gone: DataFrame, now: float, include_cloud: bool, recognition: bool, meta: dict[str, str], roots: DataFrame | None = None) -> None:
        """Reads the rows of a walk in `work`, drops the paths in `gone`, and publishes files, docs and what is searched by."""
        text = incremental.wants_text(INDEXABLE_EXTS + list(extract.PLUGINS), include_cloud)
        read = written(extract.read_files(work.where(text).select("path"), recognition), "read")
        with_text = work.join(read, "path").select("path", "name", "ext", "size", "mtime", F.lit(now).alias("indexed"), "chars", "status", "error", "is_dir")
        rows = written(with_text.unionByName(incremental.name_only(work.where(~text), now)), "rows")
        old = self.files
        new = written(incremental.upsert(old, rows).join(gone, "path", "left_anti"), "files")
        fresh = read.where("text <> ''").join(new.select("id", "path"), "path").select("id", F.col("text").alias("body"))
        changed = new.join(rows.select("path"), "path", "left_semi").select("id")
        kept = lambda table: table.join(new.join(rows.select("path"), "path", "left_anti").select("id"), "id", "left_semi")
        fresh = written(fresh, "texts")
        gen = F.lit(self.store.manifest()[0] + 1).cast("bigint").alias("gen")
        postings = fts.postings(fresh).select("term", "id", F.col("at").cast("array<int>").alias("at"), F.col("length").cast("int").alias("length"), gen)
        current = fresh.select("id", F.size(fts.tokens(F.col("body"))).alias("length"), gen)
        names = search.trigrams(new.join(changed, "id", "left_semi").join(old.select("path"), "path", "left_anti"))
        tables = {"files": new, "docs": kept(self.docs).unionByName(fresh), "current": kept(self.table("current")).unionByName(current)}
        self.store.publish(tables | ({"roots": roots} if roots is not None else {}), meta, append={"postings": postings, "grams": names.select("id", "gram")}, sort=SORTED)

    def changed(self, gone: DataFrame, seen: DataFrame, meta: dict[str, str] | None = None, now: float | None = None) -> None:
        """Takes in what a live feed tells: paths that went (with all beneath them) and rows of walks that are new or changed."""
        with self.locked(), scratch(self.spark):
            lost = written(self.files.select("path").join(incremental.forget(self.files, gone).select("path"), "path", "left_anti"), "lost")
            self._take_in(written(seen, "seen"), lost, time.time() if now is None else now, False, False, meta or {})

    def _follow(self, mounts: DataFrame) -> list[str]:
        """Moves what stands on drives that moved, stamps roots with the drive they lie on; the roots in whose place another drive is."""
        roots = self.roots
        if not mounts.limit(1).count() or not roots.limit(1).count():
            return []
        present = self.spark.createDataFrame([(r["path"],) for r in roots.select("path").collect() if r["path"] and os.path.isdir(r["path"])], "path string")
        plan = self._relocated(mounts, present)
        moved = {r["new_path"] for r in plan if r["state"] == "moved"}
        here = present.union(self.spark.createDataFrame([(p,) for p in moved], "path string"))
        self.store.publish({"roots": written(relocate.stamp(self.roots, mounts, here), "roots")})
        return [r["path"] for r in plan if r["state"] == "away"]

    def restamp(self, mounts: DataFrame | None = None) -> None:
        """Every present root takes the drive it now lies on, also in place of another."""
        mounts = volumes.mounts(self.spark) if mounts is None else mounts
        present = self.spark.createDataFrame([(r["path"],) for r in self.roots.select("path").collect() if r["path"] and os.path.isdir(r["path"])], "path string")
        with scratch(self.spark):
            self.store.publish({"roots": written(relocate.stamp(self.roots, mounts, present, force=True), "roots")})

    def hash(self, mode: str = "dupes", under: str | None = None, exts: list[str] | None = None) -> None:
        """Partial hashes, then full ones of what still collides (dupes), or all partial (all) or full (full) ones."""
        with scratch(self.spark):
            for stage in {"dupes": ("size", "partial")}.get(mode, (mode,)):
                jobs = dupes.hash_candidates(self.files, stage, under, exts)
                found = fingerprint.read_files(jobs, full=stage in ("partial", "full"))
                self.store.publish({"files": fingerprint.merged(self.files, found)})

    def fingerprint_texts(self) -> None:
        self.store.publish({"files": fingerprint.with_simhashes(self.files, self.docs)})

    def fingerprint_images(self, decode: Callable[[bytes], tuple[bytes, int, int]], under: str | None = None) -> None:
        """dhash of the pictures that have none; decode(content) gives (grey bytes, width, height) or raises."""
        rows = dupes.scoped(self.files.where(F.col("ext").isin(IMAGE_EXTS) & (F.col("is_dir") == 0) & F.col("dhash").isNull()), under)
        self.store.publish({"files": fingerprint.with_dhashes(self.files, fingerprint.read_images(rows, decode))})

    def find(self, query: str, limit: int = 50, clock: Clock | None = None, live: bool = False, snippets: bool = True) -> DataFrame:
        return search.find(self.files, self.docs, query, limit, clock, live, self.stored, snippets)

    def search(self, query: str, limit: int = 25, exts: list[str] | None = None, snippets: bool = True) -> DataFrame:
        return fts.search(self.files, self.docs, query, limit, exts, self.stored, snippets)

    def name(self, pattern: str, limit: int = 50, exts: list[str] | None = None) -> DataFrame:
        held = self.store.read("grams") if self.store.has("grams") else None
        rows = dupes.scoped(self.files, exts=exts).join(search.by_trigrams(self.files, pattern, held).select("id"), "id", "left_semi")
        return search.limited(rows.select("path", "size", "mtime", "is_dir").orderBy(F.desc("mtime"), "path"), limit)

    def dupes(self, mode: str = "name", limit: int = 0, under: str | None = None, exts: list[str] | None = None, distance: int | None = None, fresh: bool = True) -> DataFrame:
        """Sets by name, exact, near or images; exact and near first compute what is missing, unless not fresh."""
        if mode == "name":
            return dupes.by_name(self.files, limit, exts)
        if mode == "exact":
            if fresh:
                self.hash(under=under, exts=exts)
            return dupes.by_content(self.files, limit, exts, under)
        if mode == "near" and fresh:
            self.fingerprint_texts()
        groups = {"near": similarity.near_texts, "images": similarity.near_images}[mode]
        extra = {} if distance is None else {"distance": max(0, min(64, distance))}
        return dupes.first_sets(groups(dupes.scoped(self.files, exts=exts), under=under, **extra), limit)

    def dupe_records(self, mode: str = "name", limit: int = 0, under: str | None = None, exts: list[str] | None = None, distance: int | None = None, fresh: bool = True) -> DataFrame:
        """The same as result records with the number of their set and the kind of match, in order; limit counts sets."""
        if mode == "name":
            rows = dupes.name_sets(self.files, exts)
        elif mode == "exact":
            if fresh:
                self.hash(under=under, exts=exts)
            rows = dupes.content_sets(self.files)
            rows = rows.join(dupes.scoped(self.files, under, exts).select("path"), "path", "left_semi")
        else:
            rows = self.dupes(mode, 0, under, exts, distance, fresh)
        match = {"name": "name", "exact": "identical", "near": "near-text", "images": "similar-image"}[mode]
        rows = dupes.first_sets(rows, limit).select("set", F.lit(match).alias("match"), "path", "size", "mtime", F.lit(0).alias("is_dir"))
        return search.records(rows).orderBy("set", "path")

    def stats(self) -> dict[str, DataFrame]:
        f = self.files
        return {"totals": stats.totals(f), "status": stats.by_status(f), "types": stats.top_extensions(f), "errors": stats.errors(f)}

    def tree(self, out: str, fmt: str = "txt", under: str | None = None) -> None:
        f = self.files
        if under:
            f = f.join(tree.listing(f, under).select("path"), "path", "left_semi")
        if fmt == "csv":
            sinks.write_results(tree.listing(f), out, "csv")
        elif fmt in ("txt", "json"):
            with open(out, "w", encoding="utf-8") as file:
                file.writelines((line + "\n" for line in tree.drawing(f)) if fmt == "txt" else tree.as_json(f))
        else:
            raise ValueError(fmt)

    def remember(self, folders: list[str], now: float | None = None) -> None:
        walked = self.spark.createDataFrame([(os.path.abspath(f),) for f in folders], "path string")
        self.store.publish({"roots": incremental.merge_roots(self.roots, walked, now or time.time(), indexed=False)})

    def forget_roots(self, folders: list[str]) -> None:
        gone = self.spark.createDataFrame([(os.path.abspath(f),) for f in folders], "path string")
        self.store.publish({"roots": self.roots.join(gone, "path", "left_anti")}, {f"extract_version:{os.path.abspath(f)}": None for f in folders})

    def forget(self, paths: list[str]) -> None:
        with scratch(self.spark):
            left = written(incremental.forget(self.files, self.spark.createDataFrame([(p,) for p in paths], "path string")), "files")
            self.store.publish({"files": left, **self._texts_of(left)})

    def _texts_of(self, files: DataFrame) -> dict[str, DataFrame]:
        """docs and current of the files that are left. Postings of others stay until they are compacted: they are not current."""
        return {t: self.table(t).join(files.select("id"), "id", "left_semi") for t in ("docs", "current")}

    def _relocated(self, mounts: DataFrame, present: DataFrame) -> list:
        """Follows drives that moved and publishes all of it at once; the plan that was carried out, a row a root."""
        plan = written(relocate.plan(self.roots, mounts, present), "plan")
        rows = plan.collect()
        moved = {r["path"]: r["new_path"] for r in rows if r["state"] == "moved"}
        if moved:
            moves = plan.where("state = 'moved'").select("path", "new_path")
            files = written(relocate.move(self.files, moves), "files")
            roots = written(relocate.restamp(relocate.move(self.roots, moves), mounts, moves), "roots")
            meta = self.store.manifest()[1]["meta"]
            at = "extract_version:"
            versions = {k: v for k, v in meta.items() if k.startswith(at)}
            renamed = {k: None for k in versions if k[len(at) :] in moved} | {at + moved[k[len(at) :]]: v for k, v in versions.items() if k[len(at) :] in moved}
            self.store.publish({"files": files, "roots": roots, **self._texts_of(files)}, renamed)
        return rows

    def relocate(self, mounts: DataFrame, present: DataFrame) -> DataFrame:
        """Follows drives that moved; the plan that was carried out."""
        with self.locked(), scratch(self.spark):
            rows = self._relocated(mounts, present)
        return self.spark.createDataFrame(rows, "path string, state string, new_path string")

    def vacuum(self, parts: int = 8) -> None:
        """Tables rewritten sorted and in few files, postings that are no longer current dropped, old versions deleted."""
        with self.locked():
            tables = {name: self.table(name) for name in (*SCHEMAS, *STORED) if self.store.has(name)}
            if stored := self.stored:
                tables["postings"] = stored.of(F.lit(True)).select(*(c.split()[0] for c in POSTINGS.split(", ")))
            if "grams" in tables:
                tables["grams"] = tables["grams"].join(self.files.select("id"), "id", "left_semi").distinct()
            order = SORTED | {"files": ["path"], "docs": ["id"]}
            self.store.publish({n: df if n in order else df.coalesce(parts) for n, df in tables.items()}, sort=order)
            self.store.sweep()

    def clear(self) -> None:
        self.store.clear()
