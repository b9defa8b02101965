"""Hashes, types and fingerprints of contents."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.constants import DHASH_NONE, PARTIAL_BYTES, SIMHASH_MAX_CHARS, SIMHASH_MIN_CHARS
from shelfscan.session import spread

# How contents begin, in the order tried; offset, bytes, label.
SIGNATURES = (
    (0, b"%PDF", "pdf"), (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), (0, b"\x89PNG\r\n\x1a\n", "png"), (0, b"\xff\xd8\xff", "jpg"),
    (0, b"GIF87a", "gif"), (0, b"GIF89a", "gif"), (0, b"II*\x00", "tiff"), (0, b"MM\x00*", "tiff"), (0, b"\x00\x00\x01\x00", "ico"),
    (0, b"ID3", "mp3"), (0, b"\xff\xfb", "mp3"), (0, b"\xff\xf3", "mp3"), (0, b"\xff\xf2", "mp3"), (0, b"\xff\xfa", "mp3"),
    (0, b"fLaC", "flac"), (0, b"OggS", "ogg"), (0, b"\x1a\x45\xdf\xa3", "mkv"), (0, b"Rar!\x1a\x07\x00", "rar"), (0, b"Rar!\x1a\x07\x01\x00", "rar"),
    (0, b"7z\xbc\xaf\x27\x1c", "7z"), (0, b"\x1f\x8b", "gz"), (0, b"BZh", "bz2"), (0, b"\xfd7zXZ\x00", "xz"), (257, b"ustar", "tar"),
    (0, b"MZ", "exe"), (0, b"\x7fELF", "elf"), (0, b"\xca\xfe\xba\xbe", "macho"), (0, b"\xcf\xfa\xed\xfe", "macho"), (0, b"\xfe\xed\xfa\xcf", "macho"),
    (0, b"\xce\xfa\xed\xfe", "macho"), (0, b"SQLite format 3\x00", "sqlite"), (0, b"{\\rtf", "rtf"), (0, b"%!PS", "ps"), (0, b"MSCF", "cab"),
    (0, b"\x30\x26\xb2\x75", "wma"), (0, b"!<arch>\n", "ar"),
)
ZIP_MARKERS = (
    (b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"), (b"mimetypeapplication/epub", "epub"),
    (b"mimetypeapplication/vnd.oasis.opendocument.text", "odt"), (b"mimetypeapplication/vnd.oasis.opendocument.spreadsheet", "ods"),
    (b"mimetypeapplication/vnd.oasis.opendocument.presentation", "odp"), (b"META-INF/MANIFEST.MF", "jar"), (b"AndroidManifest.xml", "apk"),
)
RIFF_TAGS = {b"WEBP": "webp", b"WAVE": "wav", b"AVI ": "avi"}
BRANDS = ((b"qt", "mov"), (b"M4A", "m4a"), (b"heic", "heic"), (b"heix", "heic"), (b"mif1", "heic"))
#: Signatures shorter than a container needs: the label holds only for contents longer than this.
BITMAP_LEAST, RIFF_LEAST, TAR_LEAST = 15, 12, 263
_CONTROL = bytes(b for b in range(32) if b not in (9, 10, 11, 12, 13, 27))


#: What text in markup opens with (of XML: after a byte order mark; else after blanks, without case) and what then is within it.
MARKUP = (
    ("html", b"<?xml", (b"<html", b"xhtml")), ("svg", b"<?xml", (b"<svg",)), ("xml", b"<?xml", (b"",)),
    ("html", b"<!doctype html", (b"",)), ("html", b"<html", (b"",)), ("svg", b"<svg", (b"",)),
)
#: Bytes at the start that are looked at for the opening, and for what is within.
OPENING, WITHIN = 1024, 2048


def _zipped(head: bytes) -> str | None:
    return next((k for m, k in (*ZIP_MARKERS, (b"", "zip")) if m in head), None) if head.startswith(b"PK\x03\x04") else None


def _container(head: bytes) -> str | None:
    """Formats whose name stands behind a length."""
    if head.startswith(b"RIFF") and len(head) >= RIFF_LEAST:
        return RIFF_TAGS.get(head[8:12], "riff")
    if head.startswith(b"\x00\x00\x00") and head[4:8] == b"ftyp":
        return next(k for b, k in (*BRANDS, (b"", "mp4")) if head.startswith(b, 8))
    return "bmp" if head.startswith(b"BM") and len(head) >= BITMAP_LEAST else None


def _signed(head: bytes) -> str | None:
    return next((k for at, m, k in SIGNATURES if head.startswith(m, at) and (k != "tar" or len(head) >= TAR_LEAST)), None)


def _marked_up(head: bytes) -> str | None:
    ways = {True: head.removeprefix(b"\xef\xbb\xbf"), False: head[:OPENING].lstrip().lower()}
    low = head[:WITHIN].lower()
    return next((k for k, mark, holds in MARKUP if ways[mark == b"<?xml"].startswith(mark) and any(h in low for h in holds)), None)


def _readable(head: bytes) -> str:
    """Text holds no zero byte and at most a control character in twenty, unless it begins as wide text does."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "text"
    controls = len(head) - len(head.translate(None, _CONTROL))
    return "binary" if 0 in head or 20 * controls > len(head) else "text"


#: The rules in the order tried; the first that knows the content names it.
RULES = (lambda head: "pdf" if b"%PDF-" in head[:OPENING] else None, _zipped, _container, _signed, _marked_up, _readable)


def sniff(head: bytes | None, size: int | None = None) -> str:
    """The type of a content by its first bytes; no bytes are empty, or binary if the size says there are some."""
    if not head:
        return "binary" if size else "empty"
    return next(kind for rule in RULES if (kind := rule(head)))


def _series(fn):
    return lambda *columns: pd.Series([fn(*x) for x in zip(*columns)])


def sniffed(head: Column, size: Column) -> Column:
    return F.pandas_udf(_series(lambda h, s: sniff(h, None if pd.isna(s) else int(s))), "string")(head, size)


def partial_hash(content: Column, algorithm: str = "blake2b") -> Column:
    """Of the first PARTIAL_BYTES; null content has none. sha2 stays in the JVM and groups alike."""
    head = F.substring(content, 1, PARTIAL_BYTES)
    if algorithm == "sha2":
        return F.sha2(head, 256)
    return F.pandas_udf(_series(lambda h: None if h is None else hashlib.blake2b(h, digest_size=16).hexdigest()), "string")(head)


def full_hash(content: Column, algorithm: str = "blake2b") -> Column:
    if algorithm == "sha2":
        return F.sha2(content, 256)
    return F.pandas_udf(_series(lambda h: None if h is None else hashlib.blake2b(h, digest_size=32).hexdigest()), "string")(content)


def hashed(contents: DataFrame, algorithm: str = "blake2b") -> DataFrame:
    """id, phash, fhash, kind of contents(id, content) in cascade: all get a partial hash and a type; a full hash only contents shorter than
    PARTIAL_BYTES (their partial reading was whole) and those that share size and partial hash with another."""
    rows = contents.select("id", "content", F.length("content").cast("bigint").alias("size"))
    first = rows.select("id", "size", partial_hash(F.col("content"), algorithm).alias("phash"), sniffed(F.substring("content", 1, PARTIAL_BYTES), F.col("size")).alias("kind"))
    shared = first.where(F.col("phash").isNotNull()).groupBy("size", "phash").agg(F.count("*").alias("n")).where("n > 1").select("size", "phash")
    wanted = first.join(shared, ["size", "phash"], "left_semi").select("id").union(first.where(F.col("size") < PARTIAL_BYTES).select("id")).distinct()
    full = rows.join(wanted, "id", "left_semi").select("id", full_hash(F.col("content"), algorithm).alias("fhash"))
    return first.join(full, "id", "left").select("id", "phash", "fhash", "kind")


def simhash(docs: DataFrame, algorithm: str = "blake2b", least: int = SIMHASH_MIN_CHARS) -> DataFrame:
    """id, simhash of docs(id, body) with at least `least` characters; null for texts of fewer than three words. Words are runs of two or more
    letters, numbers or underscores of the lower-cased first SIMHASH_MAX_CHARS; three in a row vote with each of their 64 bits, a bit needs more
    than half.

    One Arrow batch at a time, a vote matrix a text: no shuffle. md5 is the form SQL can follow.
    """
    import re

    word = re.compile(r"\w{2,}")

    def bits(gram: str) -> bytes:
        raw = gram.encode("utf-8", "ignore")
        return hashlib.blake2b(raw, digest_size=8).digest() if algorithm == "blake2b" else hashlib.md5(raw).digest()[:8][::-1]

    def one(text: str) -> int | None:
        w = word.findall(text[:SIMHASH_MAX_CHARS].lower())
        if len(w) < 3:
            return None
        raw = b"".join(bits(" ".join(w[k : k + 3])) for k in range(len(w) - 2))
        votes = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        return int(np.packbits(2 * votes > len(w) - 2, bitorder="little").view("<i8")[0])

    udf = F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype="Int64"), "bigint")
    rows = spread(docs.where(F.length("body") >= least).select("id", "body"), "id")
    return rows.select("id", udf("body").alias("simhash"))


def dhash(grey: bytes, width: int, height: int) -> int | None:
    """The picture's 64 gradients: means of 9 x 8 boxes, a bit for each that is brighter than its right neighbour. Fewer than two columns or no row: none."""
    if width < 2 or height < 1:
        return None
    picture = np.frombuffer(grey, np.uint8, width * height).reshape(height, width).astype(np.float64)
    sums = np.zeros((height + 1, width + 1))
    sums[1:, 1:] = picture.cumsum(0).cumsum(1)

    def cuts(n: int, parts: int):
        lo = np.arange(parts) * n // parts
        hi = np.minimum(np.maximum(np.arange(1, parts + 1) * n // parts, lo + 1), n)
        return lo, hi

    (y0, y1), (x0, x1) = cuts(height, 8), cuts(width, 9)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    mean = total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return int(np.packbits((mean[:, :-1] > mean[:, 1:]).ravel(), bitorder="little").view("<i8")[0])


def dhashes(grey: Column, width: Column, height: Column) -> Column:
    return F.pandas_udf(lambda g, w, h: pd.Series([None if b is None else dhash(b, int(x), int(y)) for b, x, y in zip(g, w, h)], dtype="Int64"), "bigint")(grey, width, height)


def dhash_of_pixels(pixels: Column) -> Column:
    """The same of an 8 x 8 picture as an array of 64 numbers, in the JVM: its boxes are single pixels and the first column's is met twice."""
    # a box of the 9 columns starts at c * 8 // 9, so pixel c - 1 stands in column c and pixel 0 in columns 0 and 1
    column = lambda c: c * 8 // 9
    out = F.lit(0).cast("bigint")
    for r in range(8):
        for c in range(8):
            a, b = pixels[r * 8 + column(c)], pixels[r * 8 + column(c + 1)]
            out = out.bitwiseOR(F.when(a > b, F.shiftleft(F.lit(1).cast("bigint"), r * 8 + c)).otherwise(F.lit(0).cast("bigint")))
    return out


def merged(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with the hashes and types of found(id, phash, fhash, kind): a new value counts, a missing one leaves the old. One left join by id."""
    new = found.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("phash", "fhash", "kind")))
    joined = files.join(new, F.col("id") == F.col("__id"), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in ("phash", "fhash", "kind") else F.col(c) for c in files.columns))


def with_simhashes(files: DataFrame, docs: DataFrame, algorithm: str = "blake2b") -> DataFrame:
    """files with the simhashes that texts of enough characters lack; others stay."""
    lacking = files.where((F.col("chars") >= SIMHASH_MIN_CHARS) & F.col("simhash").isNull()).select("id")
    new = simhash(docs.join(lacking, "id", "left_semi"), algorithm, least=0).select(F.col("id").alias("__id"), F.col("simhash").alias("__new"))
    joined = files.join(new, F.col("id") == F.col("__id"), "left")
    return joined.select(*(F.coalesce("simhash", "__new").alias("simhash") if c == "simhash" else F.col(c) for c in files.columns))


def _stretches(path: str, most: int | None):
    """A file's first PARTIAL_BYTES, then the rest a MiB at a time; only the first if most is 1."""
    with open(path, "rb", buffering=0) as f:
        yield f.read(PARTIAL_BYTES)
        while most is None and (more := f.read(1 << 20)):
            yield more


def fingerprint_file(path: str, size: int | None, full: bool) -> tuple:
    """phash, fhash, kind of a file; unreadable is a type of its own, a file that is gone has none. The full hash of a file that ends within its
    first bytes comes with them."""
    whole, head = hashlib.blake2b(digest_size=32), None
    try:
        for stretch in _stretches(path, None if full else 1):
            head = stretch if head is None else head
            whole.update(stretch)
    except OSError as problem:
        return None, None, None if isinstance(problem, FileNotFoundError) else "unreadable"
    done = full or len(head) < PARTIAL_BYTES
    return hashlib.blake2b(head, digest_size=16).hexdigest(), whole.hexdigest() if done else None, sniff(head, size)


def read_files(jobs: DataFrame, full: bool) -> DataFrame:
    """id, phash, fhash, kind of the files of jobs(id, path, size), read where all executors see them; the largest first, spread evenly."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            found = [fingerprint_file(p, s, full) for p, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in found], pa.string()) for k in range(3))], ["id", "phash", "fhash", "kind"])

    spread = jobs.repartition(F.xxhash64("id")).sortWithinPartitions(F.desc("size"))
    return spread.select("id", "path", "size").mapInArrow(run, "id bigint, phash string, fhash string, kind string")


def read_images(rows: DataFrame, decode) -> DataFrame:
    """id, dhash of the pictures of rows(id, path), read where all executors see them; decode(content) gives grey bytes, width and height. What can't be read or decoded
    gets the sentinel DHASH_NONE, so that it is not tried again until it changes; a file that is gone none."""
    import pyarrow as pa

    def one(path: str) -> int | None:
        try:
            with open(path, "rb") as f:
                found = dhash(*decode(f.read()))
            return DHASH_NONE if found is None else found
        except FileNotFoundError:
            return None
        except Exception:  # whatever a decoder says of a file
            return DHASH_NONE

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(p) for p in b.column(1).to_pylist()], pa.int64())], ["id", "dhash"])

    return spread(rows.select("id", "path"), "id").mapInArrow(run, "id bigint, dhash bigint")


def with_dhashes(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with the dhash of found(id, dhash) where they have none."""
    joined = files.join(found.select(F.col("id").alias("__id"), F.col("dhash").alias("__new")), F.col("id") == F.col("__id"), "left")
    return joined.select(*(F.coalesce("dhash", "__new").alias("dhash") if c == "dhash" else F.col(c) for c in files.columns))
