"""The engine's own queries, one or more for each operator, and their SQL."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.functions import strings as S
from shelfscan.functions.constants import AUDIO_EXTS, CLOUD_MASK, IMAGE_EXTS, INDEXABLE_EXTS, MAX_FILE_BYTES, SKIP_DIRS, TYPE_GROUPS
from shelfscan.operators import dupes, fingerprint, fts, incremental, relocate, similarity, stats, tree
from shelfscan.plans import search
from shelfscan.plans.fixtures import FORMATS, content
from shelfscan.plans.query import Clock, parse
from shelfscan.session import load, written
from shelfscan.streaming import watch

#: The moment the queries of ages count from.
NOW = 1772500000.0
CLOCK = Clock(NOW, "UTC")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def lc(c: str) -> str:
    return f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _files(spark, d):
    return load(spark, d, "files")


# --- changed records ---------------------------------------------------------------


@add("p5_found", r"""
        WITH s AS (
          SELECT s.path, s.size, s.mtime, s.seen, r.last_index,
                 row_number() OVER (PARTITION BY s.path ORDER BY s.seen DESC, s.size DESC NULLS LAST, s.mtime DESC NULLS LAST) n
          FROM scan s JOIN roots r ON starts_with(s.path, r.path || CASE WHEN contains(r.path, '\') THEN '\' ELSE '/' END)
          WHERE s.is_dir = 0)
        SELECT s.path FROM s LEFT JOIN files f ON f.path = s.path
        WHERE n = 1 AND (last_index IS NULL OR last_index < seen) AND (f.path IS NULL OR f.indexed < seen)
          AND (f.path IS NULL OR s.size IS DISTINCT FROM f.size OR f.status = 'error'
               OR (s.mtime IS NULL) <> (f.mtime IS NULL) OR abs(s.mtime - f.mtime) >= 1e-6)""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from shelfscan.operators.change_capture import run

    return run(load(spark, d, "scan"), _files(spark, d), load(spark, d, "roots")).select("path")


# --- predicates and the query language -----------------------------------------------


def _where(name: str, text: str, condition: str) -> None:
    """A query of the language that conditions alone decide, over the whole table."""
    add(name, f"SELECT id, path FROM files WHERE {condition}")(lambda spark, d: search.filtered(_files(spark, d), parse(text, CLOCK)).select("id", "path"))


def _day(y: int, m: int = 1, day: int = 1) -> float:
    return CLOCK.period(f"{y}-{m}-{day}")[0]


YEAR = 365.25 * 86400
_where("name_substr", "IMG_", f"{lc('name')} LIKE '%img!_%' ESCAPE '!'")
_where("name_wildcard", "read*.p?f", f"{lc('name')} LIKE 'read%.p_f'")
_where("name_not", "!readme !*2019*", f"NOT {lc('name')} LIKE '%readme%' AND NOT {lc('name')} LIKE '%2019%'")
_where("path_scope", r'/srv/archive path:"D:\Projekte"', rf"({lc('path')} LIKE '/srv/archive/%' OR starts_with({lc('path')}, 'd:\projekte\'))")
_where("path_not", "!/srv/archive !/home/veldt/Documents/", f"NOT starts_with({lc('path')}, '/srv/archive/') AND NOT starts_with({lc('path')}, '/home/veldt/documents/')")
_where("ext_in", "ext:pdf;DOCX,.txt", "ext IN ('.pdf', '.docx', '.txt')")
_where("ext_not_in", "!ext:pdf;jpg", "ext NOT IN ('.pdf', '.jpg')")
_where("kind_file", "file:", "is_dir = 0")
_where("kind_folder", "folder:20", f"is_dir = 1 AND {lc('name')} LIKE '%20%'")
_where("when_before", "before:2018", f"mtime < {_day(2018)}")
_where("when_after", "after:2019-06", f"mtime >= {_day(2019, 7)}")
_where("when_since", "since:15/03/2020", f"mtime >= {_day(2020, 3, 15)}")
_where("when_modified", "modified:2018..2020-02", f"mtime >= {_day(2018)} AND mtime < {_day(2020, 3)}")
_where("when_not", "!modified:2021 !before:2015", f"NOT (mtime >= {_day(2021)} AND mtime < {_day(2022)}) AND NOT (mtime < {_day(2015)})")
_where("when_older", "older:3y", f"mtime < {NOW - 3 * YEAR}")
_where("when_newer", "newer:90d", f"mtime >= {NOW - 90 * 86400}")
_where("size_gt", "size:>10kb", "size >= 10240")
_where("size_lt", "size:<1kb", "size < 1024")
_where("size_range", "size:1kb..1.5mb", "size >= 1024 AND size < 1572864")
_where("size_eq", "size:=0", "size >= 0 AND size < 1")
_where("size_not", "!size:>100mb", "NOT (size >= 104857600)")
_where("half_typed", "before:20 size:> after:2018..2020 readme", f"{lc('name')} LIKE '%readme%'")


@add("under_scope", f"SELECT id, path FROM files WHERE starts_with({lc('path')}, '/srv/archive/')")
def under_scope(spark, d):
    return dupes.scoped(_files(spark, d), "/srv/archive").select("id", "path")


@add("type_group", f"SELECT id, path FROM files WHERE ext IN {listed(TYPE_GROUPS['images'])}")
def type_group(spark, d):
    return search.of_type(_files(spark, d), "images").select("id", "path")


@add("name_trigram", f"SELECT id, path, name FROM files WHERE {lc('name')} LIKE '%letter%'")
def name_trigram(spark, d):
    return search.by_trigrams(_files(spark, d), "Letter")


@add("find_flagship", f"""
        SELECT path, size, mtime, is_dir, CAST(NULL AS DOUBLE) AS score FROM files
        WHERE {lc('name')} LIKE '%readme%' AND ext IN ('.pdf', '.txt', '.md') AND size >= 2048 AND NOT (mtime < {_day(2015)})""")
def find_flagship(spark, d):
    return search.find(_files(spark, d), None, "readme ext:pdf;txt;md size:>2kb !before:2015", 0, CLOCK)


@add("browse_newest", "SELECT path, size, mtime, is_dir FROM files ORDER BY mtime DESC NULLS LAST, path LIMIT 50")
def browse_newest(spark, d):
    return search.find(_files(spark, d), None, "", 50, CLOCK).drop("score")


@add("topk_newest", "SELECT path, mtime FROM files WHERE ext = '.pdf' ORDER BY mtime DESC NULLS LAST, path LIMIT 10")
def topk_newest(spark, d):
    return search.find(_files(spark, d), None, "ext:pdf", 10, CLOCK).select("path", "mtime")


@add("name_weighted", f"""
        SELECT path, mtime FROM files WHERE {lc('name')} LIKE '%read%'
        ORDER BY ({lc('name')} = 'read' OR starts_with({lc('name')}, 'read.')) DESC, starts_with({lc('name')}, 'read') DESC, mtime DESC NULLS LAST, path LIMIT 50""")
def name_weighted(spark, d):
    return search.find(_files(spark, d), None, "Read", 50, CLOCK).select("path", "mtime")


def _placed(ordered: DataFrame) -> DataFrame:
    """Rows in order with their place: an offset a sorted partition, so that an order of the whole table can be compared."""
    at = F.monotonically_increasing_id()
    held = written(ordered.withColumn("at", at))
    counts = sorted((r[0], r[1]) for r in held.groupBy(F.shiftright("at", 33)).count().collect())
    first = {p: sum(n for q, n in counts if q < p) for p, _ in counts}
    before = F.coalesce(F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.shiftright("at", 33)], F.lit(0)) if first else F.lit(0)
    return held.withColumn("place", before + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)


for _by, _desc, _key in (
    ("name", False, r"lower(regexp_extract(path, '([^/\\]*)$', 1)) ASC NULLS FIRST"), ("size", True, "size DESC NULLS LAST"),
    ("modified", False, "mtime ASC NULLS FIRST"), ("folder", True, r"lower(regexp_replace(path, '[/\\][^/\\]*$', '')) DESC NULLS LAST"),
):
    add(f"resort_{_by}", f"SELECT path, size, row_number() OVER (ORDER BY {_key}, path) AS place FROM files")(
        lambda spark, d, by=_by, desc=_desc: _placed(search.resorted(_files(spark, d).select("path", "size", "mtime", "is_dir"), by, desc)).select("path", "size", "place")
    )


@add("result_record", r"""
        WITH f AS (SELECT path, size, mtime, is_dir FROM files UNION ALL SELECT path || '/', NULL, NULL, 0 FROM files WHERE id % 5 = 0 UNION ALL SELECT path || '\', NULL, 0.0, 1 FROM files WHERE id % 7 = 0),
        x AS (SELECT *, regexp_extract(regexp_replace(path, '[/\\]+$', ''), '([^/\\]*)$', 1) AS b, regexp_extract(path, '([^/\\]*)$', 1) AS last FROM f)
        SELECT path, CASE WHEN is_dir = 1 THEN '' ELSE lower(regexp_extract(last, '^\.*[^.].*(\.[^.]*)$', 1)) END AS ext, CASE WHEN b = '' OR regexp_matches(b, '^[A-Za-z]:$') THEN path ELSE b END AS name,
               CASE WHEN is_dir = 0 THEN coalesce(size, 0) END AS size,
               CASE WHEN coalesce(mtime, 0) <> 0 THEN strftime(make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS modified,
               CASE WHEN is_dir = 1 THEN 'folder' ELSE 'file' END AS kind FROM x""")
def result_record(spark, d):
    f = _files(spark, d).select("id", "path", "size", "mtime", "is_dir")
    odd = lambda end, n, mtime, is_dir: f.where(F.col("id") % n == 0).select("id", F.concat("path", F.lit(end)).alias("path"), F.lit(None).cast("bigint").alias("size"), F.lit(mtime).cast("double").alias("mtime"), F.lit(is_dir).alias("is_dir"))
    return search.records(f.union(odd("/", 5, None, 0)).union(odd("\\", 7, 0.0, 1)).drop("id"))


# --- full text -----------------------------------------------------------------------

TOKENS = rf"regexp_extract_all(translate(lower(body), '{fts.MARKED}', '{fts.BARE}'), '{fts.TOKEN}')"
WITH_T = f"WITH t AS (SELECT id, {TOKENS} AS l FROM docs WHERE body IS NOT NULL)"


def _count(*words: str, prefix: bool = False) -> str:
    tests = [f"l[i + {k}] = '{w}'" for k, w in enumerate(words)]
    if prefix:
        tests[-1] = f"starts_with(l[i + {len(words) - 1}], '{words[-1]}')"
    return f"len(list_filter(range(1, len(l) + 1), lambda i: {' AND '.join(tests)}))"


def _match(name: str, text: str, condition: str) -> None:
    add(name, f"{WITH_T} SELECT id FROM t WHERE {condition}")(lambda spark, d: fts.matching(load(spark, d, "docs"), text))


_match("fts_term", "kettle", f"{_count('kettle')} > 0")
_match("fts_and", "kettle note", f"{_count('kettle')} > 0 AND {_count('note')} > 0")
_match("fts_or", "isotope OR (levadura AND cebolla)", f"{_count('isotope')} > 0 OR ({_count('levadura')} > 0 AND {_count('cebolla')} > 0)")
_match("fts_not", "server NOT cache NOT parser", f"{_count('server')} > 0 AND {_count('cache')} = 0 AND {_count('parser')} = 0")
_match("fts_phrase", '"as noted"', f"{_count('as', 'noted')} > 0")
_match("fts_phrase_plus", "is + still + open", f"{_count('is', 'still', 'open')} > 0")
_match("fts_prefix", "budg*", f"{_count('budg', prefix=True)} > 0")
_match("fts_folded", "prüfen OR resume", f"{_count('prufen')} > 0 OR {_count('resume')} > 0")
_match("fts_near", "NEAR(kettle every, 6)", """
        len(list_filter(range(1, len(l) + 1), lambda i: (l[i] = 'kettle' AND list_contains(l[i + 1 : i + 7], 'every'))
            OR (l[i] = 'every' AND list_contains(l[i + 1 : i + 7], 'kettle')))) > 0""")
_match("fts_initial", "^ the", "l[1] = 'the'")


@add("fts_exclude", f"""{WITH_T} SELECT path FROM files WHERE ext = '.pdf' AND id NOT IN (SELECT id FROM t WHERE {_count('kettle')} > 0 AND {_count('the')} > 0)""")
def fts_exclude(spark, d):
    return search.find(_files(spark, d), load(spark, d, "docs"), "ext:pdf !content:kettle !content:the", 0, CLOCK).select("path")


@add("fts_tokens", f"{WITH_T} SELECT id, array_to_string(l, ' ') AS tokens FROM t WHERE len(l) > 0")
def fts_tokens(spark, d):
    t = fts.tokens(F.col("body"))
    return load(spark, d, "docs").select("id", t.alias("t")).where(F.size("t") > 0).select("id", F.array_join("t", " ").alias("tokens"))


@add("fts_vocab", f"{WITH_T}, w AS (SELECT id, unnest(l) AS term FROM t) SELECT term, count(DISTINCT id) AS docs, count(*) AS hits FROM w GROUP BY term")
def fts_vocab(spark, d):
    return fts.vocabulary(load(spark, d, "docs"))


def _bm25(*phrases: tuple[str, ...]) -> str:
    f = ", ".join(f"{_count(*p)} AS f{k}" for k, p in enumerate(phrases))
    n = ", ".join(f"count_if(f{k} > 0) AS n{k}" for k in range(len(phrases)))
    part = " ".join(
        f"- greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(phrases))
    )
    held = " AND ".join(f"f{k} > 0" for k in range(len(phrases)))
    return f"""{WITH_T}, c AS (SELECT id, len(l) AS dl, {f} FROM t), g AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean, {n} FROM c),
        hits AS (SELECT id, round(0.0 {part}, 6) AS score FROM c, g WHERE {held})"""


@add("fts_bm25", _bm25(("kettle",), ("as", "noted")) + " SELECT id, score FROM hits")
def fts_bm25(spark, d):
    return fts.ranked(load(spark, d, "docs"), 'kettle "as noted"').select("id", F.round("score", 6).alias("score"))


@add("fts_join_files", _bm25(("isotope",)) + " SELECT path, score FROM hits JOIN files USING (id) WHERE ext IN ('.txt', '.pdf')")
def fts_join_files(spark, d):
    return search.find(_files(spark, d), load(spark, d, "docs"), "content:isotope ext:txt;pdf", 0, CLOCK).select("path", F.round("score", 6).alias("score"))


@add("search_rows", _bm25(("kettle",), ("note",)) + " SELECT path, score FROM hits JOIN files USING (id) ORDER BY score, path LIMIT 25")
def search_rows(spark, d):
    return fts.search(_files(spark, d), load(spark, d, "docs"), "kettle note").select("path", F.round("score", 6).alias("score"))


@add("fts_fallback", f"""{WITH_T} SELECT id FROM t WHERE {_count('note', prefix=True)} > 0 AND {_count('say', prefix=True)} > 0""")
def fts_fallback(spark, d):
    return fts.matching(load(spark, d, "docs"), fts.safe("note, AND say"))


@add("fts_snippet")
def fts_snippet(spark, d):
    docs = load(spark, d, "docs")
    hits = fts.search(_files(spark, d), docs, 'kettle "as noted"', 25).join(_files(spark, d).select("path", "id"), "path").join(docs, "id")
    return hits.select("path", fts.snippet(F.col("body"), 'kettle "as noted"').alias("snippet"))


# --- duplicates ------------------------------------------------------------------------

NAMED = "(SELECT name, size, count(*) AS copies FROM files WHERE is_dir = 0 AND size > 0 GROUP BY name, size HAVING count(*) > 1)"
EXACT = "(SELECT fhash, count(*) AS copies FROM files WHERE is_dir = 0 AND fhash IS NOT NULL AND size > 0 GROUP BY fhash HAVING count(*) > 1)"


@add("dupes_name_size", f"SELECT name, size, copies, path, mtime FROM files JOIN {NAMED} USING (name, size) WHERE is_dir = 0")
def dupes_name_size(spark, d):
    return dupes.by_name(_files(spark, d))


@add("dupes_name_size_summary", f"SELECT count(*) AS groups, CAST(coalesce(sum(copies), 0) AS BIGINT) AS files, CAST(coalesce(sum((copies - 1) * size), 0) AS BIGINT) AS wasted FROM {NAMED}")
def dupes_name_size_summary(spark, d):
    return dupes.by_name_summary(_files(spark, d))


@add("dupes_exact", f"SELECT path, size, mtime, copies, fhash FROM files JOIN {EXACT} USING (fhash) WHERE is_dir = 0")
def dupes_exact(spark, d):
    return dupes.by_content(_files(spark, d))


@add("dupes_exact_under", f"SELECT path, copies FROM files JOIN {EXACT} USING (fhash) WHERE is_dir = 0 AND starts_with({lc('path')}, '/srv/archive/')")
def dupes_exact_under(spark, d):
    return dupes.by_content(_files(spark, d), under="/srv/archive").select("path", "copies")


@add("dupes_exact_summary", """
        SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS wasted
        FROM (SELECT fhash, count(*) AS n, max(size) AS size FROM files WHERE is_dir = 0 AND fhash IS NOT NULL AND size > 0 GROUP BY fhash HAVING count(*) > 1)""")
def dupes_exact_summary(spark, d):
    return dupes.by_content_summary(_files(spark, d))


@add("dupes_under", f"""
        WITH r AS (SELECT name, size, path FROM files JOIN {NAMED} USING (name, size) WHERE is_dir = 0 AND starts_with({lc('path')}, '/srv/archive/'))
        SELECT name, size, path FROM r JOIN (SELECT name, size FROM r GROUP BY name, size HAVING count(*) > 1) USING (name, size)""")
def dupes_under(spark, d):
    return dupes.under(dupes.by_name(_files(spark, d)), "/srv/archive", ["name", "size"]).select("name", "size", "path")


for _keep, _order in (("newest", "mtime DESC NULLS LAST, path"), ("oldest", "mtime ASC NULLS FIRST, path"), ("first", "path")):
    add(f"dupes_keep_{_keep}", f"""
        SELECT fhash, path FROM (SELECT fhash, path, row_number() OVER (PARTITION BY fhash ORDER BY {_order}) n FROM files JOIN {EXACT} USING (fhash) WHERE is_dir = 0) WHERE n > 1""")(
        lambda spark, d, keep=_keep: dupes.to_remove(dupes.by_content(_files(spark, d)), keep, "fhash").select("fhash", "path")
    )


def _sets(column: str, where: str, bands: int, distance: int) -> str:
    """Groups of like fingerprints in SQL: banded pairs of distinct ones, components by a recursive query, sets in order."""
    width = 64 // bands
    return f"""
        r AS (SELECT {column} AS v, path, size, mtime FROM files WHERE is_dir = 0 AND {where}), u AS (SELECT DISTINCT v FROM r),
        b AS (SELECT v, k, (v >> CAST(k * {width} AS INT)) & {(1 << width) - 1} AS key FROM u, range({bands}) x(k)),
        e AS (SELECT DISTINCT x.v AS v, y.v AS w FROM b x JOIN b y ON x.k = y.k AND x.key = y.key AND x.v <> y.v AND bit_count(xor(x.v, y.v)) <= {distance}),
        c AS (SELECT v, v AS g FROM u UNION SELECT e.w, c.g FROM c JOIN e ON c.v = e.v),
        l AS (SELECT v, min(g) AS label FROM c GROUP BY v),
        m AS (SELECT *, count(*) OVER (PARTITION BY label) AS files, max(coalesce(size, 0)) OVER (PARTITION BY label) AS big, min(path) OVER (PARTITION BY label) AS head FROM r JOIN l USING (v)),
        sets AS (SELECT dense_rank() OVER (ORDER BY files DESC, big DESC, head) AS "set", files, path, size, mtime FROM m WHERE files > 1)"""


NEAR = _sets("simhash", "simhash IS NOT NULL", 4, 3)
IMAGES = _sets("dhash", "dhash <> -9223372036854775808 AND bit_count(dhash) BETWEEN 9 AND 55", 8, 10)


@add("dupes_near", f'WITH RECURSIVE {NEAR} SELECT "set", files, path, size, mtime FROM sets')
def dupes_near(spark, d):
    return similarity.near_texts(_files(spark, d))


@add("dupes_near_limit", f'WITH RECURSIVE {NEAR} SELECT "set", files, path FROM sets WHERE "set" <= 5')
def dupes_near_limit(spark, d):
    return dupes.first_sets(similarity.near_texts(_files(spark, d)), 5).select("set", "files", "path")


@add("dupes_images", f'WITH RECURSIVE {IMAGES} SELECT "set", files, path, size, mtime FROM sets')
def dupes_images(spark, d):
    return similarity.near_images(_files(spark, d))


def _tagged(ctes: str, tag: str) -> str:
    for name in ("r", "u", "b", "e", "c", "l", "m", "sets"):
        ctes = ctes.replace(f"        {name} AS (", f"        {tag}{name} AS (").replace(f" {name} AS (SELECT DISTINCT v", f" {tag}{name} AS (SELECT DISTINCT v")
    for a in (" FROM r", " FROM u", " JOIN e ", " JOIN b ", " FROM b ", " FROM c ", " JOIN l ", " FROM m "):
        word = a.split()[1]
        ctes = ctes.replace(a, a.replace(word, tag + word))
    return ctes.replace("SELECT e.w, c.g", f"SELECT {tag}e.w, {tag}c.g").replace("ON c.v = e.v", f"ON {tag}c.v = {tag}e.v")


@add("dupes_combined", f"""
        WITH RECURSIVE {_tagged(NEAR, 'n')}, {_tagged(IMAGES, 'i')},
        x AS (SELECT dense_rank() OVER (ORDER BY big DESC, fhash) AS "set", path, size, mtime
              FROM (SELECT fhash, path, size, mtime, max(size) OVER (PARTITION BY fhash) AS big FROM files JOIN {EXACT} USING (fhash) WHERE is_dir = 0)),
        k AS (SELECT (SELECT max("set") FROM x) AS a, (SELECT coalesce(max("set"), 0) FROM nsets) AS b)
        SELECT "set", 'identical' AS match, path, size, mtime FROM x
        UNION ALL SELECT "set" + coalesce(a, 0), 'near-text', path, size, mtime FROM nsets, k
        UNION ALL SELECT "set" + coalesce(a, 0) + b, 'similar-image', path, size, mtime FROM isets, k""")
def dupes_combined(spark, d):
    return dupes.combined(_files(spark, d))


# --- fingerprints ------------------------------------------------------------------------


@add("near_pairs", f"WITH RECURSIVE {NEAR} SELECT v, w FROM e WHERE v < w")
def near_pairs(spark, d):
    return similarity.banded_pairs(_files(spark, d).where("is_dir = 0").select(F.col("simhash").alias("v")), 3)


@add("hamming", """
        SELECT p.id_a, p.id_b, via, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS text_bits, CAST(bit_count(xor(a.dhash, b.dhash)) AS INT) AS image_bits
        FROM near_pairs p JOIN files a ON a.id = p.id_a JOIN files b ON b.id = p.id_b""")
def hamming(spark, d):
    f = _files(spark, d)
    side = lambda x: f.select(F.col("id").alias(f"id_{x}"), F.col("simhash").alias(f"s_{x}"), F.col("dhash").alias(f"d_{x}"))
    pairs = load(spark, d, "near_pairs").join(side("a"), "id_a").join(side("b"), "id_b")
    return pairs.select("id_a", "id_b", "via", similarity.hamming(F.col("s_a"), F.col("s_b")).alias("text_bits"), similarity.hamming(F.col("d_a"), F.col("d_b")).alias("image_bits"))


@add("simhash", r"""
        WITH w AS (SELECT id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}') AS l FROM docs WHERE length(body) >= 200),
        g AS (SELECT id, unnest(list_transform(range(1, len(l) - 1), lambda i: ('0x' || substr(md5(l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]), 1, 16))::UBIGINT)) AS h FROM w WHERE len(l) > 2),
        v AS (SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS vote FROM g, range(64) x(b) GROUP BY id, b),
        s AS (SELECT id, sum(CASE WHEN vote > 0 THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b::INT) END ELSE 0 END) AS s FROM v GROUP BY id)
        SELECT w.id, s.s::BIGINT AS simhash FROM w LEFT JOIN s ON s.id = w.id""")
def simhash(spark, d):
    return fingerprint.simhash(load(spark, d, "docs"), "md5")


@add("simhash_stored", "SELECT id, simhash FROM files JOIN docs USING (id) WHERE simhash IS NOT NULL")
def simhash_stored(spark, d):
    """The form an index uses, against the fingerprints it stores."""
    held = _files(spark, d).where("simhash IS NOT NULL").select("id")
    return fingerprint.simhash(load(spark, d, "docs").join(held, "id", "left_semi"))


def _box(k: int, n: int, parts: int) -> range:
    """The pixels of one of `parts` boxes over n."""
    return range(k * n // parts, max(k * n // parts + 1, (k + 1) * n // parts))


def _mean(r: int, c: int) -> str:
    pixels = [f"px[{y * 16 + x + 1}]" for y in _box(r, 4, 8) for x in _box(c, 16, 9)]
    return f"({' + '.join(pixels)})::DOUBLE / {len(pixels)}"


@add("dhash_boxes", "WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(0, least(255, 128 + 40 * x::DOUBLE))) AS INT)) AS px FROM embeddings) SELECT vec_id, CAST(" + " + ".join(
    f"CASE WHEN {_mean(r, c)} > {_mean(r, c + 1)} THEN {'-9223372036854775808' if r * 8 + c == 63 else 1 << (r * 8 + c)}::HUGEINT ELSE 0 END" for r in range(8) for c in range(8)
) + " AS BIGINT) AS dhash FROM p")
def dhash_boxes(spark, d):
    """Means over boxes, of pictures of 16 x 4 grey pixels."""
    grey = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 40 * x.cast("double")))).cast("int"))
    hexed = F.array_join(F.transform(grey, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return load(spark, d, "embeddings").select("vec_id", fingerprint.dhashes(F.unhex(hexed), F.lit(16), F.lit(4)).alias("dhash"))


@add("dhash", "SELECT vec_id, CAST(" + " + ".join(
    f"CASE WHEN embedding[{r * 8 + c * 8 // 9 + 1}] > embedding[{r * 8 + (c + 1) * 8 // 9 + 1}] THEN {'-9223372036854775808' if r * 8 + c == 63 else 1 << (r * 8 + c)}::HUGEINT ELSE 0 END" for r in range(8) for c in range(8)
) + " AS BIGINT) AS dhash FROM embeddings")
def dhash(spark, d):
    return load(spark, d, "embeddings").select("vec_id", fingerprint.dhash_of_pixels(F.col("embedding")).alias("dhash"))


def _contents(spark, d):
    return load(spark, d, "docs").where("body IS NOT NULL").select("id", F.encode("body", "UTF-8").alias("content"))


@add("hash_fhash", "SELECT id, sha256(body) AS fhash FROM docs WHERE body IS NOT NULL")
def hash_fhash(spark, d):
    return _contents(spark, d).select("id", fingerprint.full_hash(F.col("content"), "sha2").alias("fhash"))


@add("hash_phash", "SELECT id, sha256(encode(body)[1:16384]) AS phash FROM docs WHERE body IS NOT NULL")
def hash_phash(spark, d):
    return _contents(spark, d).select("id", fingerprint.partial_hash(F.col("content"), "sha2").alias("phash"))


@add("hash_cascade", """
        WITH b AS (SELECT id, body, strlen(body) AS size, sha256(encode(body)[1:16384]) AS phash FROM docs WHERE body IS NOT NULL),
        s AS (SELECT size, phash FROM b GROUP BY size, phash HAVING count(*) > 1)
        SELECT id, phash, CASE WHEN size < 16384 OR (size, phash) IN (SELECT (size, phash) FROM s) THEN sha256(body) END AS fhash FROM b""")
def hash_cascade(spark, d):
    return fingerprint.hashed(_contents(spark, d), "sha2").select("id", "phash", "fhash")


@add("hash_blake2b")
def hash_blake2b(spark, d):
    return fingerprint.hashed(_contents(spark, d))


# Contents and the types they have.
KINDS = [
    ("", "empty"), ("255044462d312e34", "pdf"), ("504b0304" + b"word/".hex(), "docx"), ("504b0304", "zip"), (b"RIFF0000WAVEfmt ".hex(), "wav"), (b"RIFF0000ABCDefgh".hex(), "riff"), (b"BM".hex() + "01" * 13, "bmp"),
    ("00000018" + b"ftypqt  ".hex(), "mov"), ("00000018" + b"ftypM4A ".hex(), "m4a"), ("00000018" + b"ftypisom".hex(), "mp4"), ("89504e470d0a1a0a", "png"), ("ffd8ffe0", "jpg"), ("1f8b08", "gz"), ("00" * 257 + b"ustar".hex() + "00", "tar"),
    ("efbbbf" + b"<?xml?><svg>".hex(), "svg"), (b"<?xml?><a/>".hex(), "xml"), (b"<?xml?><html>".hex(), "html"), (b"  <!DOCTYPE HTML>".hex(), "html"), (b"{\\rtf1}".hex(), "rtf"), ("fffe6800", "text"), ("610062", "binary"), (b"plain".hex(), "text"),
    ("0101" + "61" * 30, "binary"), ("0101" + "61" * 40, "text"), ("d0cf11e0a1b11ae1", "ole"), (b"GIF89a".hex(), "gif"), (b"fLaC".hex(), "flac"), ("7f454c46", "elf"),
]


@add("sniff_kind", "SELECT doc_id, kind FROM documents, (VALUES " + ", ".join(f"({k}, '{kind}')" for k, (_, kind) in enumerate(KINDS)) + f") x(k, kind) WHERE doc_id % {len(KINDS)} = k")
def sniff_kind(spark, d):
    """A content of each type, by the documents' ids."""
    contents = F.array(*(F.unhex(F.lit(h)) for h, _ in KINDS))
    rows = load(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", contents[F.pmod("doc_id", F.lit(len(KINDS))).cast("int")].alias("content"))
    return rows.select("doc_id", fingerprint.sniffed(F.substring("content", 1, 16384), F.length("content").cast("bigint")).alias("kind"))


#: Contents of which the digests are fixed values of the algorithm.
DIGESTS = [(t, hashlib.blake2b(t.encode(), digest_size=16).hexdigest(), hashlib.blake2b(t.encode(), digest_size=32).hexdigest()) for t in ("", "abc", "ä" * 9000, "x" * 20000)]


@add("hash_digests", "SELECT doc_id, phash, fhash FROM documents, (VALUES " + ", ".join(f"({k}, '{hashlib.blake2b(t.encode()[:16384], digest_size=16).hexdigest()}', '{f}')" for k, (t, _, f) in enumerate(DIGESTS)) + f") x(k, phash, fhash) WHERE doc_id % {len(DIGESTS)} = k")
def hash_digests(spark, d):
    texts = F.array(*(F.lit(t) for t, _, _ in DIGESTS))
    rows = load(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.encode(texts[F.pmod("doc_id", F.lit(len(DIGESTS))).cast("int")], "UTF-8").alias("content"))
    return rows.select("doc_id", fingerprint.partial_hash(F.col("content")).alias("phash"), fingerprint.full_hash(F.col("content")).alias("fhash"))


@add("hash_candidates_colliding", """
        WITH f AS (SELECT id, path, size, is_dir, 'p' || (size % 3) AS phash, CASE WHEN id % 2 = 0 THEN fhash END AS fhash FROM files)
        SELECT id, path, size FROM f WHERE is_dir = 0 AND size > 0 AND fhash IS NULL AND phash IS NOT NULL
          AND (size, phash) IN (SELECT (size, phash) FROM f WHERE is_dir = 0 AND phash IS NOT NULL GROUP BY size, phash HAVING count(*) > 1)""")
def hash_candidates_colliding(spark, d):
    """The last stage where partial hashes collide, which is rare in an index that has done its hashing."""
    f = _files(spark, d).withColumn("phash", F.concat(F.lit("p"), F.col("size") % 3)).withColumn("fhash", F.when(F.col("id") % 2 == 0, F.col("fhash")))
    return dupes.hash_candidates(f, "partial")


for _mode, _cond in (
    ("all", "phash IS NULL"), ("full", "fhash IS NULL"),
    ("size", "phash IS NULL AND size IN (SELECT size FROM files WHERE is_dir = 0 AND size > 0 GROUP BY size HAVING count(*) > 1)"),
    ("partial", "fhash IS NULL AND phash IS NOT NULL AND (size, phash) IN (SELECT (size, phash) FROM files WHERE is_dir = 0 AND phash IS NOT NULL GROUP BY size, phash HAVING count(*) > 1)"),
):
    add(f"hash_candidates_{_mode}", f"SELECT id, path, size FROM files WHERE is_dir = 0 AND size > 0 AND {_cond}")(lambda spark, d, mode=_mode: dupes.hash_candidates(_files(spark, d), mode))


# --- figures and trees ---------------------------------------------------------------------


@add("stats_totals", "SELECT count(*) AS total, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, count_if(is_dir = 1) AS folders FROM files")
def stats_totals(spark, d):
    return stats.totals(_files(spark, d))


@add("stats_header", "SELECT count(*) AS total, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, count_if(status = 'error') AS errors, count_if(is_dir = 1) AS folders FROM files")
def stats_header(spark, d):
    return stats.header(_files(spark, d))


@add("stats_by_status", "SELECT status, count(*) AS n FROM files GROUP BY status")
def stats_by_status(spark, d):
    return stats.by_status(_files(spark, d))


@add("stats_top_ext", "SELECT ext, count(*) AS n, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars FROM files WHERE is_dir = 0 GROUP BY ext ORDER BY n DESC, ext LIMIT 15")
def stats_top_ext(spark, d):
    return stats.top_extensions(_files(spark, d))


@add("stats_errors", "SELECT (SELECT count(*) FROM files WHERE status = 'error') AS n, path, error FROM files WHERE status = 'error' ORDER BY path LIMIT 10")
def stats_errors(spark, d):
    return stats.errors(_files(spark, d))


FAMILIES = " UNION ALL ".join(f"SELECT '{g}' AS name, unnest([{', '.join(repr(e) for e in m)}]) AS ext" for g, m in TYPE_GROUPS.items())


@add("type_counts", f"""
        WITH e AS (SELECT ext, count(*) AS n FROM files WHERE is_dir = 0 AND ext <> '' GROUP BY ext ORDER BY n DESC, ext LIMIT 500), f AS ({FAMILIES})
        SELECT 'ext' AS kind, ext AS name, n FROM e UNION ALL SELECT 'family', f.name, CAST(sum(n) AS BIGINT) FROM e JOIN f USING (ext) GROUP BY f.name
        UNION ALL SELECT 'folders', 'folders', count_if(is_dir = 1) FROM files""")
def type_counts(spark, d):
    return stats.type_counts(_files(spark, d))


ROOT = r"CASE WHEN regexp_matches(path, '^[A-Za-z]:') THEN path[1:2] || '\' WHEN starts_with(path, '\\') OR starts_with(path, '//') THEN '\\' WHEN starts_with(path, '/') THEN '/' WHEN starts_with(path, '\') THEN '\' ELSE '' END"
PARTS = r"list_filter(string_split_regex(regexp_replace(path, '^([A-Za-z]:[\\/]?|[\\/]{1,2})', ''), '[/\\]+'), lambda x: x <> '')"


@add("tree_rollup", f"""
        WITH p AS (SELECT {ROOT} AS root, {PARTS} AS parts, size, is_dir FROM files),
        x AS (SELECT *, unnest(range(0, greatest(0, CASE WHEN is_dir = 1 THEN len(parts) ELSE len(parts) - 1 END) + 1)) AS k FROM p)
        SELECT root, array_to_string(parts[1:k], '/') AS folder, CAST(sum(CASE WHEN is_dir = 0 THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS size, count_if(is_dir = 0) AS files
        FROM x GROUP BY root, folder""")
def tree_rollup(spark, d):
    return tree.rollup(_files(spark, d))


@add("tree_csv", r"""
        SELECT path, CASE WHEN is_dir = 1 THEN 'folder' ELSE 'file' END AS type, CASE WHEN is_dir = 0 THEN coalesce(size, 0) END AS size,
               CASE WHEN coalesce(mtime, 0) <> 0 THEN strftime(make_timestamp(CAST(floor(mtime) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS modified FROM files""")
def tree_csv(spark, d):
    return tree.listing(_files(spark, d))


@add("tree_counts", "SELECT count_if(is_dir = 1) AS folders, count_if(is_dir = 0) AS files FROM files")
def tree_counts(spark, d):
    return tree.counts(_files(spark, d))


# --- the index in step ------------------------------------------------------------------------

RETRY = "coalesce(status = 'error' AND NOT coalesce(starts_with(error, 'extractor '), FALSE), FALSE)"
RETRY_OCR = f"({RETRY} OR coalesce(status IN ('ok', 'empty') AND coalesce(chars, 0) < 100 AND NOT coalesce(error = 'ocr', FALSE) AND ext IN {listed(['.pdf', *IMAGE_EXTS])}, FALSE))"
WANTS = f"coalesce(is_dir = 0 AND ext IN {listed(INDEXABLE_EXTS)} AND (size <= {MAX_FILE_BYTES} OR ext IN {listed(AUDIO_EXTS)}) AND is_cloud = 0, FALSE)"


@add("scan_cloud_flag", f"SELECT path, batch, seen, (size & {CLOUD_MASK}) <> 0 AS cloud FROM scan")
def scan_cloud_flag(spark, d):
    return load(spark, d, "scan").select("path", "batch", "seen", incremental.is_cloud(F.col("size")).alias("cloud"))


#: A folder that is the same wherever the queries run: the smallest test tables.
WALKED = "/root/testdata/sf0.001"


@add("scan_files", f"SELECT file AS path, regexp_extract(file, '[^/]*$') AS name, '.parquet' AS ext, 0 AS is_dir, 1 AS listed FROM glob('{WALKED}/**')")
def scan_files(spark, d):
    from shelfscan.sources.walk import walk

    return walk(spark, [WALKED]).select("path", "name", "ext", "is_dir", "listed")


@add("eligible_text", f"SELECT path, batch, seen, {WANTS} AS eligible FROM scan")
def eligible_text(spark, d):
    return load(spark, d, "scan").select("path", "batch", "seen", incremental.wants_text().alias("eligible"))


@add("roots_denest", f"""
        WITH k AS (SELECT {lc(r"regexp_replace(path, '(.)[/\\]+$', '\1')")} AS k, min(path) AS path FROM (SELECT path FROM roots UNION SELECT path FROM files WHERE is_dir = 1) GROUP BY 1)
        SELECT path FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE starts_with(k.k, o.k || CASE WHEN contains(o.k, '\\') THEN '\\' ELSE '/' END))""".replace("'\\\\'", "'\\'"))
def roots_denest(spark, d):
    both = load(spark, d, "roots").select("path").union(_files(spark, d).where("is_dir = 1").select("path"))
    return incremental.denest(both)


@add("roots_list", "SELECT path, added FROM roots")
def roots_list(spark, d):
    return load(spark, d, "roots").orderBy("added", "path").select("path", "added")


@add("root_of", r"""
        SELECT id, (SELECT max_by(r.path, length(r.path)) FROM roots r WHERE starts_with(f.path, r.path || CASE WHEN contains(r.path, '\') THEN '\' ELSE '/' END)) AS root FROM files f""")
def root_of(spark, d):
    from shelfscan.operators.roots import with_root

    return with_root(_files(spark, d), load(spark, d, "roots"), "path", "root").select("id", "root")


@add("known_state", f"SELECT id, path, size, mtime, status, {RETRY} AS retry FROM files")
def known_state(spark, d):
    return incremental.known_state(_files(spark, d))


@add("incr_retry", f"SELECT id, path, {RETRY_OCR} AS retry FROM files")
def incr_retry(spark, d):
    return _files(spark, d).select("id", "path", incremental.retry(ocr=True).alias("retry"))


ACTIONS = f"""
        s AS (SELECT * FROM (SELECT path, size, mtime, ext, {WANTS} AS wants,
                row_number() OVER (PARTITION BY path ORDER BY size DESC NULLS LAST, mtime DESC NULLS LAST, ext DESC NULLS LAST, {WANTS} DESC) AS n FROM scan WHERE path IS NOT NULL) WHERE n = 1),
        k AS (SELECT path, size, mtime, status, {RETRY} AS retry FROM files),
        actions AS (SELECT coalesce(s.path, k.path) AS path,
          CASE WHEN s.path IS NULL THEN 'unseen' WHEN k.path IS NULL THEN 'new'
               WHEN NOT (s.size IS NOT DISTINCT FROM k.size AND ((s.mtime IS NULL AND k.mtime IS NULL) OR coalesce(abs(s.mtime - k.mtime) < 1e-6, FALSE))) THEN 'changed'
               WHEN wants AND coalesce(status = 'listed', FALSE) THEN 'newly-eligible' WHEN wants AND retry THEN 'retry'
               WHEN wants AND ext = '.docx' THEN 'stale' ELSE 'unchanged' END AS action
          FROM s FULL JOIN k ON s.path = k.path)"""


@add("incr_classify", f"WITH {ACTIONS} SELECT path, action FROM actions")
def incr_classify(spark, d):
    return incremental.classify(load(spark, d, "scan"), _files(spark, d), stale_exts=[".docx"])


@add("run_stats", f"WITH {ACTIONS} SELECT action, count(*) AS n FROM actions GROUP BY action")
def run_stats(spark, d):
    return incremental.run_stats(incr_classify(spark, d))


def _latest(spark, d):
    scan = load(spark, d, "scan").where(F.col("path").isNotNull())
    return scan.groupBy("path").agg(F.max(F.struct("seen", "size", "mtime", "name", "ext", "is_dir")).alias("x")).select("path", "x.name", "x.ext", "x.size", "x.mtime", "x.is_dir")


LATEST = """latest AS (SELECT path, name, ext, size, mtime, is_dir FROM (SELECT *, row_number() OVER (PARTITION BY path
          ORDER BY seen DESC, size DESC NULLS LAST, mtime DESC NULLS LAST, name DESC, ext DESC, is_dir DESC) AS n FROM scan WHERE path IS NOT NULL) WHERE n = 1)"""


@add("name_only_rows", f"""WITH {LATEST} SELECT path, name, ext, size, mtime, {NOW}::DOUBLE AS indexed, 0 AS chars,
        CASE WHEN is_dir = 1 THEN 'folder' ELSE 'listed' END AS status, '' AS error, is_dir FROM latest""")
def name_only_rows(spark, d):
    return incremental.name_only(_latest(spark, d), NOW)


@add("upsert_invalidate", f"""
        WITH {LATEST}, top AS (SELECT max(id) AS top FROM files),
        fresh AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM latest WHERE path NOT IN (SELECT path FROM files))
        SELECT coalesce(f.id, top + fresh.n) AS id, coalesce(f.path, l.path) AS path, CASE WHEN f.id IS NULL THEN l.name ELSE f.name END AS name,
          CASE WHEN l.path IS NULL THEN f.size ELSE l.size END AS size, CASE WHEN l.path IS NULL THEN f.mtime ELSE l.mtime END AS mtime,
          CASE WHEN l.path IS NULL THEN f.status WHEN l.is_dir = 1 THEN 'folder' ELSE 'listed' END AS status,
          CASE WHEN l.path IS NULL OR (f.size = l.size AND f.mtime = l.mtime) THEN f.phash END AS phash, CASE WHEN l.path IS NULL OR (f.size = l.size AND f.mtime = l.mtime) THEN f.fhash END AS fhash,
          CASE WHEN l.path IS NULL OR (f.size = l.size AND f.mtime = l.mtime) THEN f.kind END AS kind, CASE WHEN l.path IS NULL OR (f.size = l.size AND f.mtime = l.mtime) THEN f.dhash END AS dhash,
          CASE WHEN l.path IS NULL OR (f.size = l.size AND f.mtime = l.mtime AND f.chars = 0) THEN f.simhash END AS simhash
        FROM files f FULL JOIN latest l ON f.path = l.path LEFT JOIN fresh ON fresh.path = l.path, top""")
def upsert_invalidate(spark, d):
    return incremental.upsert(_files(spark, d), incremental.name_only(_latest(spark, d), NOW)).select("id", "path", "name", "size", "mtime", "status", "phash", "fhash", "kind", "dhash", "simhash")


@add("incr_prune", r"""
        SELECT id, path FROM files f WHERE path NOT IN (SELECT path FROM scan WHERE path IS NOT NULL) AND NOT starts_with(path, '/srv/archive/')
          AND EXISTS (SELECT 1 FROM roots r WHERE starts_with(f.path, r.path || CASE WHEN contains(r.path, '\') THEN '\' ELSE '/' END))""")
def incr_prune(spark, d):
    blind = spark.createDataFrame([("/srv/archive",)], "path string")
    return incremental.vanished(_files(spark, d), load(spark, d, "scan"), load(spark, d, "roots"), blind).select("id", "path")


@add("forget_paths", r"""
        WITH p AS (SELECT path, is_dir FROM files WHERE name IN ('old', 'tmp', 'drafts') OR status = 'error')
        SELECT id, path FROM files f WHERE path NOT IN (SELECT path FROM p)
          AND NOT EXISTS (SELECT 1 FROM p WHERE is_dir = 1 AND starts_with(f.path, p.path || CASE WHEN contains(p.path, '\') THEN '\' ELSE '/' END))""")
def forget_paths(spark, d):
    f = _files(spark, d)
    return incremental.forget(f, f.where("name IN ('old', 'tmp', 'drafts') OR status = 'error'").select("path")).select("id", "path")


@add("roots_merge", f"""
        WITH w AS (SELECT path FROM roots WHERE last_index IS NULL OR volume_id IS NULL UNION SELECT '/new/place')
        SELECT coalesce(r.path, w.path) AS path, coalesce(added, {NOW}) AS added, CASE WHEN w.path IS NOT NULL THEN {NOW} ELSE last_index END AS last_index FROM roots r FULL JOIN w ON r.path = w.path""")
def roots_merge(spark, d):
    roots = load(spark, d, "roots")
    walked = roots.where("last_index IS NULL OR volume_id IS NULL").select("path").union(spark.createDataFrame([("/new/place",)], "path string"))
    return incremental.merge_roots(roots, walked, NOW, indexed=True).select("path", "added", "last_index")


# --- relocation ----------------------------------------------------------------------------------

#: Two drives that swapped letters, one mounted elsewhere, one in its place.
MOUNTS = [("6E35-3216", "E:\\", "Projekte"), ("1607-5A95", "D:\\", "Scans"), ("F108-E7F6", "/mnt2", "Ledger"), ("A584-09AB", "/srv", "Archive")]
MOVES = [("D:\\Projekte", "E:\\Projekte"), ("E:\\Scans", "D:\\Scans"), ("/srv/ledger", "/mnt2/ledger")]


def _mounts(spark):
    return spark.createDataFrame(MOUNTS, "volume_id string, mount string, label string")


def _present(spark, d):
    return load(spark, d, "roots").where("path LIKE '/srv/arch%' OR path LIKE 'E:%' OR volume_id IS NULL").select("path")


LOCATED = (
    "m(volume_id, mount, label) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MOUNTS) + r"""),
        x AS (SELECT r.*, (r.path LIKE '/srv/arch%' OR r.path LIKE 'E:%' OR r.volume_id IS NULL) AS here, o.mount AS own_mount, o.volume_id IS NOT NULL AS known,
                (SELECT max_by(m.volume_id, length(m.mount)) FROM m WHERE starts_with(r.path || CASE WHEN contains(r.path, '\') THEN '\' ELSE '/' END, rtrim(m.mount, '\/') || CASE WHEN contains(r.path, '\') THEN '\' ELSE '/' END)) AS now_id
              FROM roots r LEFT JOIN m o ON o.volume_id = r.volume_id)"""
)


@add("vol_describe", f"""WITH {LOCATED} SELECT path, last_index, coalesce(volume_label, '') AS label,
        CASE WHEN here AND (volume_id IS NULL OR now_id IS NULL OR now_id = volume_id) THEN 'ok' WHEN here THEN 'different drive here'
             WHEN volume_id IS NOT NULL AND known THEN 'connected elsewhere' ELSE 'not connected' END AS state FROM x""")
def vol_describe(spark, d):
    return relocate.describe(load(spark, d, "roots"), _mounts(spark), _present(spark, d))


@add("vol_plan", rf"""WITH {LOCATED},
        y AS (SELECT *, CASE WHEN volume_id IS NULL THEN CASE WHEN here THEN 'ok' ELSE 'missing' END WHEN here AND (now_id IS NULL OR now_id = volume_id) THEN 'ok'
             WHEN NOT known THEN CASE WHEN here THEN 'away' ELSE 'missing' END WHEN mount IS NULL OR lower(rtrim(own_mount, '\/')) = lower(rtrim(mount, '\/')) THEN 'missing' ELSE 'moved' END AS state FROM x)
        SELECT path, state, CASE WHEN state = 'moved' THEN rtrim(own_mount, '\/') || CASE WHEN contains(own_mount, '\') THEN '\' ELSE '/' END || ltrim(substr(path, length(rtrim(mount, '\/')) + 1), '\/') END AS new_path FROM y""")
def vol_plan(spark, d):
    return relocate.plan(load(spark, d, "roots"), _mounts(spark), _present(spark, d))


@add("vol_stamp", rf"""WITH {LOCATED} SELECT path, CASE WHEN t THEN now_id ELSE volume_id END AS volume_id, CASE WHEN t THEN n.label ELSE volume_label END AS volume_label
        FROM (SELECT *, here AND now_id IS NOT NULL AND (volume_id IS NULL OR volume_id = now_id) AS t FROM x) LEFT JOIN (SELECT volume_id AS v, label FROM m) n ON n.v = now_id""")
def vol_stamp(spark, d):
    return relocate.stamp(load(spark, d, "roots"), _mounts(spark), _present(spark, d)).select("path", "volume_id", "volume_label")


MOVED = "v(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MOVES) + ")"


@add("vol_apply", rf"""
        WITH {MOVED}, x AS (SELECT f.id, f.path, v.a, v.b, EXISTS (SELECT 1 FROM v s WHERE f.path = s.b OR starts_with(f.path, s.b || CASE WHEN contains(s.b, '\') THEN '\' ELSE '/' END)) AS stale
          FROM files f LEFT JOIN v ON f.path = v.a OR starts_with(f.path, v.a || CASE WHEN contains(v.a, '\') THEN '\' ELSE '/' END))
        SELECT id, CASE WHEN a IS NULL THEN path ELSE b || substr(path, length(a) + 1) END AS path FROM x WHERE a IS NOT NULL OR NOT stale""")
def vol_apply(spark, d):
    return relocate.move(_files(spark, d), spark.createDataFrame(MOVES, "path string, new_path string")).select("id", "path")


# --- the live feed ----------------------------------------------------------------------------------


@add("watch_fold", """
        WITH e AS (SELECT event_id, ts, event_type, '/corpus/u' || user_id || '/f' || (event_id % 5) || '.txt' AS path, '/corpus/u' || user_id || '/m' || (event_id % 5) || '.txt' AS target FROM events WHERE NOT (event_id % 7 = 0 AND event_type IN ('view', 'click'))),
        x AS (SELECT event_id, ts, path, CASE WHEN event_type IN ('error', 'purchase') THEN 'delete' ELSE 'upsert' END AS op FROM e
              UNION ALL SELECT event_id, ts, target, 'upsert' FROM e WHERE event_type = 'purchase')
        SELECT path, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC, op DESC) AS n FROM x) WHERE n = 1""")
def watch_fold(spark, d):
    return watch.fold(change_events(load(spark, d, "events"))).select("path", "op")


def change_events(events: DataFrame) -> DataFrame:
    """The event table read as changes of files."""
    at = lambda kind: F.concat(F.lit("/corpus/u"), F.col("user_id"), F.lit(f"/{kind}"), F.col("event_id") % 5, F.lit(".txt"))
    op = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "moved").when(F.col("event_type") == "signup", "created").otherwise("modified")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), at("f").alias("path"), at("m").alias("to_path"), (F.col("event_id") % 7 == 0).cast("int").alias("is_dir"))


ODD_PATH = "CASE id % 4 WHEN 0 THEN '/srv/Node_Modules/' || name WHEN 1 THEN 'D:\\$Trash\\' || name WHEN 2 THEN '/srv/x/node_modules' ELSE path END"


@add("watch_skip", rf"""SELECT id, path FROM (SELECT id, {ODD_PATH} AS path FROM files) WHERE len(list_filter(list_slice(string_split_regex(lower(path), '[/\\]'), 1, len(string_split_regex(path, '[/\\]')) - 1),
        lambda p: starts_with(p, '$') OR p IN {listed(SKIP_DIRS)})) > 0""")
def watch_skip(spark, d):
    n = F.col("id") % 4
    path = F.when(n == 0, F.concat(F.lit("/srv/Node_Modules/"), "name")).when(n == 1, F.concat(F.lit("D:\\$Trash\\"), "name")).when(n == 2, F.lit("/srv/x/node_modules")).otherwise(F.col("path"))
    return _files(spark, d).select("id", path.alias("path")).where(watch.skipped(F.col("path"))).select("id", "path")


@add("watch_apply", r"""
        WITH gone AS (SELECT path, is_dir FROM files WHERE status = 'error' OR name IN ('old', 'tmp', 'drafts'))
        SELECT path FROM files f WHERE path NOT IN (SELECT path FROM gone)
          AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.is_dir = 1 AND starts_with(f.path, g.path || CASE WHEN contains(g.path, '\') THEN '\' ELSE '/' END))
        UNION ALL SELECT path || '.new' FROM files WHERE id % 9 = 0""")
def watch_apply(spark, d):
    """A batch of deletions, with all beneath deleted folders, and of new paths."""
    f = _files(spark, d).where("path IS NOT NULL")
    at = F.lit(None).cast("timestamp").alias("ts")
    gone = f.where("status = 'error' OR name IN ('old', 'tmp', 'drafts')").select("path", F.lit("delete").alias("op"), "is_dir", at)
    new = f.where("id % 9 = 0").select(F.concat("path", F.lit(".new")).alias("path"), F.lit("upsert").alias("op"), F.lit(0).alias("is_dir"), at)
    return watch.apply(f.select("path", "is_dir", at), gone.union(new)).select("path")


# --- scalar functions ----------------------------------------------------------------------------------


@add("fn_human", """SELECT id, CASE WHEN size < 1024 THEN printf('%.0fB', size::DOUBLE) WHEN size < 1048576 THEN printf('%.0fKB', size / 1024) WHEN size < 1073741824 THEN printf('%.0fMB', size / 1048576)
        WHEN size < 1099511627776 THEN printf('%.0fGB', size / 1073741824) ELSE printf('%.1fTB', size / 1099511627776) END AS human FROM files WHERE size >= 0""")
def fn_human(spark, d):
    return _files(spark, d).where("size >= 0").select("id", S.human(F.col("size")).alias("human"))


@add("fn_human_bytes", """SELECT id, CASE WHEN size >= 1073741824 THEN CASE WHEN size / 1073741824 < 10 THEN printf('%.1f GB', size / 1073741824) ELSE printf('%.0f GB', size / 1073741824) END
        WHEN size >= 1048576 THEN CASE WHEN size / 1048576 < 10 THEN printf('%.1f MB', size / 1048576) ELSE printf('%.0f MB', size / 1048576) END
        WHEN size >= 1024 THEN CASE WHEN size / 1024 < 10 THEN printf('%.1f KB', size / 1024) ELSE printf('%.0f KB', size / 1024) END ELSE size || ' B' END AS human FROM files WHERE size >= 0""")
def fn_human_bytes(spark, d):
    return _files(spark, d).where("size >= 0").select("id", S.human_bytes(F.col("size")).alias("human"))


@add("fn_path_parts", r"""SELECT id, CASE WHEN regexp_extract(path, '([^/\\]*)$', 1) = '' THEN path ELSE regexp_extract(path, '([^/\\]*)$', 1) END AS base,
        regexp_replace(path, '[/\\][^/\\]*$', '') AS folder, lower(regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1)) AS ext FROM files""")
def fn_path_parts(spark, d):
    return _files(spark, d).select("id", S.basename(F.col("path")).alias("base"), S.dirname(F.col("path")).alias("folder"), S.extension(F.col("name")).alias("ext"))


@add("fn_split_path", f"SELECT id, {ROOT} AS root, array_to_string({PARTS}, '|') AS parts FROM files")
def fn_split_path(spark, d):
    return _files(spark, d).select("id", S.root_part(F.col("path")).alias("root"), F.array_join(S.path_parts(F.col("path")), "|").alias("parts"))


@add("fn_progress", "SELECT batch, path, seen, CAST(batch AS VARCHAR) AS done, coalesce(CAST(size AS VARCHAR), '') AS bytes FROM scan")
def fn_progress(spark, d):
    line = F.concat(F.lit("@P done="), F.col("batch"), F.lit(" bytes="), F.coalesce(F.col("size").cast("string"), F.lit("")))
    return load(spark, d, "scan").select("batch", "path", "seen", S.progress(line).alias("p")).select("batch", "path", "seen", F.col("p")["done"].alias("done"), F.col("p")["bytes"].alias("bytes"))


# --- texts of files -----------------------------------------------------------------------------------


#: What str.strip() takes away.
STRIPPED = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x0c]"


@add("extract_plain", rf"""
        WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\x{{feff}}', ''), '[ \t\r\f\x0b\xa0]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents),
        s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^{STRIPPED}+', ''), '{STRIPPED}+$', '') AS t FROM t)
        SELECT '/corpus/' || doc_id || '.txt' AS path, CASE WHEN t = '' THEN 'empty' ELSE 'ok' END AS status, length(t) AS chars, md5(t) AS digest FROM s""")
def extract_plain(spark, d):
    from shelfscan.sources.extract import extracted

    rows = load(spark, d, "documents").where("doc_id IS NOT NULL")
    contents = rows.select(F.concat(F.lit("/corpus/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return extracted(contents).select("path", "status", "chars", F.md5(F.encode("text", "UTF-8")).alias("digest"))


LETTERS = r"[^\p{L}\p{N}]"


@add("extract_formats", rf"""
        SELECT doc_id, x.ext, md5(regexp_replace(text, '{LETTERS}', '', 'g')) AS letters FROM documents, (SELECT unnest([{', '.join(repr(x) for x in FORMATS)}]) AS ext) x WHERE text IS NOT NULL""")
def extract_formats(spark, d):
    """Each text as a file of each type, and the letters and digits that its reader gives back."""
    from shelfscan.sources.extract import extracted

    rows = load(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.explode(F.array(*(F.lit(x) for x in FORMATS))).alias("ext"))
    made = F.pandas_udf(lambda t, x: pd.Series([content(a, b) for a, b in zip(t, x)]), "binary")
    each = rows.select(F.concat("doc_id", "ext").alias("path"), made("text", "ext").alias("content"))
    read = extracted(each).where("status <> 'error'")
    return read.select(F.regexp_extract("path", r"^-?\d+", 0).cast("bigint").alias("doc_id"), F.regexp_extract("path", r"\.\w+$", 0).alias("ext"), F.md5(F.encode(F.regexp_replace("text", LETTERS, ""), "UTF-8")).alias("letters"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The one-line query: names, types, sizes, dates and ranked text at once."""
    return search.find(_files(spark, d), load(spark, d, "docs"), "content:the !ext:log size:>0 !before:1990", 50, CLOCK)
