"""Specifications compiled to DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.constants import TYPE_GROUPS
from shelfscan.functions.strings import ascii_lower, basename, fold, like_escape, local_time, within
from shelfscan.plans.query import Clock, QuerySpec, Range, extensions, parse


def name_matches(name: Column, term: str) -> Column:
    """The name holds the term; with * or ? the whole name has its form. A to Z without case."""
    if "*" in term or "?" in term:
        pattern = like_escape(fold(term)).replace("*", "%").replace("?", "_")
        return F.like(ascii_lower(name), F.lit(pattern), F.lit("!"))
    return ascii_lower(name).contains(fold(term))


def in_range(c: Column, r: Range) -> Column | None:
    parts = [c >= F.lit(r.lo)] if r.lo is not None else []
    parts += [c < F.lit(r.hi)] if r.hi is not None else []
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0] & parts[1]
    return ~both if r.negated else both


def scope(folder: str) -> str:
    return os.path.expanduser(folder) if folder.startswith("~") else folder


def conditions(spec: QuerySpec) -> list[Column]:
    """Everything of the specification that a files row alone decides; three-valued, so a null never passes a negation."""
    name, path, ext = F.col("name"), F.col("path"), F.col("ext")
    out = [name_matches(name, t) for t in spec.name] + [~name_matches(name, t) for t in spec.name_not]
    if spec.paths:
        hit = within(path, scope(spec.paths[0]))
        for p in spec.paths[1:]:
            hit = hit | within(path, scope(p))
        out.append(hit)
    out += [~within(path, scope(p)) for p in spec.paths_not]
    if spec.exts:
        out.append(ext.isin(spec.exts))
    if spec.exts_not:
        out.append(~ext.isin(spec.exts_not))
    if spec.kind:
        out.append(F.col("is_dir") == (1 if spec.kind == "folder" else 0))
    out += [c for c in (in_range(F.col("mtime"), r) for r in spec.when) if c is not None]
    out += [c for c in (in_range(F.col("size"), r) for r in spec.sizes) if c is not None]
    return out


def filtered(files: DataFrame, spec: QuerySpec) -> DataFrame:
    for c in conditions(spec):
        files = files.where(c)
    return files


def weighted(spec: QuerySpec) -> list[Column]:
    """Exact names (but for an extension) first, then names that begin with the first term, then the newest."""
    first = fold(spec.name[0].strip("*?").lower()) if spec.name else ""
    name = ascii_lower(F.col("name"))
    newest = [F.col("mtime").desc_nulls_last(), F.col("path")]
    if not first:
        return newest
    exact = (name == first) | name.startswith(first + ".")
    return [exact.desc(), name.startswith(first).desc(), *newest]


def limited(df: DataFrame, limit: int) -> DataFrame:
    """The first rows; 0 is all of them."""
    return df.limit(limit) if limit > 0 else df


def find(files: DataFrame, docs: DataFrame | None, text: str, limit: int = 50, clock: Clock | None = None, live: bool = False, stored=None, snippets: bool = False) -> DataFrame:
    """path, size, mtime, is_dir, score (null without content terms) of the query's rows, in order; with snippets also the stretch of each text that
    holds the most hits (null without content terms). Rows without text never match a content term. stored: the index's postings (fts.Stored), read in place of the texts.

    Conditions stay plain columns, so those on ext, size, mtime and is_dir reach the scan; a limit becomes a top-k. Content
    terms are matched first and their hits joined by id. Null and blank queries give every row, newest first; empty tables none.
    """
    from shelfscan.operators import fts

    spec = parse(text, clock)
    rows = filtered(files.select("id", "path", "name", "ext", "size", "mtime", "is_dir"), spec)
    if spec.content_not:
        gone = fts.matching(docs, fts.safe(" ".join(spec.content_not), negative=True), stored)
        rows = rows.join(gone, "id", "left_anti")
    if not spec.content:
        rows = rows.withColumn("score", F.lit(None).cast("double")).orderBy(*weighted(spec))
        out = limited(rows.select("path", "size", "mtime", "is_dir", "score"), limit)
        return out.withColumn("snippet", F.lit(None).cast("string")) if snippets else out
    terms = list(spec.content)
    if live and (terms[-1][-1].isalnum() or terms[-1][-1] == "_"):
        terms[-1] += "*"
    node = fts.safe(" ".join(terms))
    hits = limited(rows.join(fts.ranked(docs, node, stored), "id").orderBy("score", "path"), limit)
    if snippets:
        hits = fts.with_snippets(hits, docs, node, ["score", "path"])
    return hits.select("path", "size", "mtime", "is_dir", "score", *(["snippet"] if snippets else []))


def records(rows: DataFrame) -> DataFrame:
    """Result rows (path, size, mtime, is_dir, more) as records. name is the last part of the path without separators at its end (the path where
    nothing or a drive is left); folders have neither size nor ext, a file's unknown size is 0; modified is empty for no time; marks of hits are taken
    out of a snippet."""
    folder = F.coalesce(F.col("is_dir") == 1, F.lit(False))
    last = F.regexp_extract(F.regexp_replace("path", r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    ext = F.lower(F.regexp_extract(F.regexp_extract("path", r"([^/\\]*)$", 1), r"^\.*[^.].*(\.[^.]*)$", 1))
    more = [c for c in rows.columns if c not in ("path", "size", "mtime", "is_dir")]
    return rows.select(
        "path", F.when((last == "") | last.rlike("^[A-Za-z]:$"), F.col("path")).otherwise(last).alias("name"), F.when(folder, "").otherwise(ext).alias("ext"), F.when(~folder, F.coalesce("size", F.lit(0))).alias("size"),
        F.when(F.coalesce(F.col("mtime"), F.lit(0.0)) != 0, local_time(F.col("mtime"))).otherwise("").alias("modified"), F.when(folder, "folder").otherwise("file").alias("kind"),
        *(F.regexp_replace(c, ">>|<<", "").alias(c) if c == "snippet" else F.col(c) for c in more),
    )


def of_type(files: DataFrame, choice: str) -> DataFrame:
    """The rows of a type filter: a family, folders, or extensions as typed; nothing typed filters nothing."""
    if choice.lower() in ("folder", "folders", "dir"):
        return files.where(F.col("is_dir") == 1)
    exts = TYPE_GROUPS.get(choice.lower()) or extensions(choice)
    return files.where(F.col("ext").isin(exts)) if exts else files


def resorted(rows: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Result rows by name, folder (without case), size or modified; ties by path."""
    key = {"name": F.lower(basename(F.col("path"))), "folder": F.lower(F.regexp_replace("path", r"[/\\][^/\\]*$", "")), "size": F.col("size"), "modified": F.col("mtime")}[by]
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "path")


def by_trigrams(files: DataFrame, term: str, stored: DataFrame | None = None) -> DataFrame:
    """id, path, name of the files whose name holds the term. With stored (the table of trigrams(), sorted by trigram, of which only the term's row groups are
    read) the names are narrowed by it before the exact test; without, and for terms of fewer than three characters or with wildcards, the names are
    tested directly: building the index for one term would cost more than the scan."""
    rows = files.select("id", "path", "name")
    grams = sorted({fold(term)[k : k + 3] for k in range(len(term) - 2)})
    if stored is not None and grams and "*" not in term and "?" not in term:
        held = stored.where(F.col("gram").isin(grams)).groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(grams))
        rows = rows.join(held.select("id"), "id", "left_semi")
    return rows.where(name_matches(F.col("name"), term))


def trigrams(files: DataFrame) -> DataFrame:
    """gram, id: the distinct three characters in a row of each name, A to Z folded."""
    name = ascii_lower(F.col("name"))
    grams = F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(name, i, F.lit(3)))
    return files.where(F.length("name") >= 3).select("id", F.explode(F.array_distinct(grams)).alias("gram"))
