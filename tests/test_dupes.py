import hashlib
import random
from itertools import combinations

from pyspark.sql import functions as F

from shelfscan.operators import dupes, fingerprint, similarity


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_by_name(make_files):
    f = make_files({"path": "/a/x", "size": 5}, {"path": "/b/x", "size": 5}, {"path": "/c/X", "size": 5}, {"path": "/d/x", "size": 6}, {"path": "/e/z", "size": 0}, {"path": "/f/z", "size": 0}, {"path": "/g/n", "size": None}, {"path": "/h/n", "size": None}, {"path": "/i/x", "size": 5, "is_dir": 1})
    assert rows(dupes.by_name(f), "path", "copies") == [("/a/x", 2), ("/b/x", 2)]
    assert dupes.by_name(f, limit=1).count() == 1  # the limit may cut a set
    assert dupes.by_name_summary(f).collect()[0].asDict() == {"groups": 1, "files": 2, "wasted": 5}
    assert dupes.by_name_summary(f.limit(0)).collect()[0].asDict() == {"groups": 0, "files": 0, "wasted": 0}
    assert dupes.under(dupes.by_name(f), "/a", ["name", "size"]).count() == 0


def test_by_content_and_keep(make_files):
    f = make_files({"path": "/a/1", "size": 5, "fhash": "h", "mtime": 1.0}, {"path": "/a/2", "size": 5, "fhash": "h", "mtime": 9.0}, {"path": "/b/3", "size": 5, "fhash": "h", "mtime": None}, {"path": "/b/4", "size": 5, "fhash": None}, {"path": "/b/5", "size": 5, "fhash": "H"})
    assert rows(dupes.by_content(f, under="/b"), "path", "copies") == [("/b/3", 3)]
    assert dupes.by_content_summary(f, under="/b").collect()[0]["groups"] == 0
    d = dupes.by_content(f)
    assert rows(dupes.to_remove(d, "newest", "fhash"), "path") == [("/a/1",), ("/b/3",)]
    assert rows(dupes.to_remove(d, "oldest", "fhash"), "path") == [("/a/1",), ("/a/2",)]
    assert rows(dupes.to_remove(d, "first", "fhash"), "path") == [("/a/2",), ("/b/3",)]


def test_candidates(make_files):
    f = make_files({"path": "/a/1", "size": 5}, {"path": "/b/2", "size": 5, "phash": "p"}, {"path": "/b/3", "size": 5, "phash": "p", "fhash": "f"}, {"path": "/b/4", "size": 9}, {"path": "/b/5", "size": 0})
    ids = lambda mode, **k: rows(dupes.hash_candidates(f, mode, **k), "id")
    assert ids("all") == [(1,), (4,)] and ids("full") == [(1,), (2,), (4,)] and ids("size") == [(1,)] and ids("partial") == [(2,)]
    assert ids("size", scope="/b") == []


def brute(values, distance, bands):
    """Groups by union of all pairs that share a band, as lists of positions."""
    width, parent = 64 // bands, list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        a, b = values[i] & (2**64 - 1), values[j] & (2**64 - 1)
        if bin(a ^ b).count("1") <= distance and any((a >> k * width) % (1 << width) == (b >> k * width) % (1 << width) for k in range(bands)):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(values)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


def test_groups_against_brute_force(make_files):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 1, 3, 4, 12]))) for b in base for _ in range(6)]
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    f = make_files(*({"path": f"/p/{i:03}", "size": i, "simhash": v, "dhash": v} for i, v in enumerate(values)))
    for df, distance, bands in ((similarity.near_texts(f), 3, 4), (similarity.near_images(f), 10, 8)):
        got = {}
        for r in df.collect():
            got.setdefault(r["set"], []).append(int(r["path"][3:]))
        assert sorted(map(sorted, got.values())) == brute(values, distance, bands)
        sizes = [len(got[k]) for k in sorted(got)]
        assert sorted(got) == list(range(1, len(got) + 1)) and sizes == sorted(sizes, reverse=True)
    kinds = rows(dupes.combined(f).groupBy("match").agg(F.min("set").alias("a"), F.max("set").alias("b")), "a", "b")
    assert kinds[0][0] == 1 and kinds[1][0] == kinds[0][1] + 1


def test_full_buckets_are_met_in_full(spark, monkeypatch):
    rng = random.Random(6)
    copies = spark.createDataFrame([(7,)] * 2001 + [(6,), (7 | 1 << 40,)], "v long")
    assert rows(similarity.banded_pairs(copies, 3), "v", "w") == [(6, 7), (6, 7 | 1 << 40), (7, 7 | 1 << 40)]
    assert similarity.banded_pairs(copies, 3, hot_bucket=2000).count() == 0
    monkeypatch.setattr(similarity, "BLOCK", 7)
    values = sorted({sum(1 << k for k in rng.sample(range(24), 4)) for _ in range(120)})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for distance, bands in ((3, 4), (10, 8)):
        want = [(a, b) for a, b in combinations(values, 2) if bin(a ^ b).count("1") <= distance]  # the upper bands are equal
        assert rows(similarity.banded_pairs(df, distance), "v", "w") == want


def test_images_without_features_and_empty(make_files):
    f = make_files({"dhash": 0}, {"dhash": 1}, {"dhash": -(1 << 63)}, {"dhash": -1}, {"dhash": None})
    assert similarity.near_images(f).count() == 0 and similarity.near_texts(f).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "v long, w long")
    assert similarity.connected(edges).where("label <> 0").count() == 0


def test_simhash_by_its_definition(spark):
    import re

    def want(text):
        w = re.findall(r"\w{2,}", text[:100_000].lower())
        if len(w) < 3:
            return None
        votes = [0] * 64
        for k in range(len(w) - 2):
            h = int.from_bytes(hashlib.blake2b(" ".join(w[k : k + 3]).encode(), digest_size=8).digest(), "little")
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        n = sum(1 << b for b in range(64) if votes[b] > 0)
        return n - (1 << 64) if n >> 63 else n

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Été", "alpha", "b_2", "x", "γάμμα", "don't"]) for _ in range(n)) for n in (60, 90, 300)] + ["a " * 150, "word " * 2 + " " * 200, None, "short"]
    got = {r[0]: r[1] for r in fingerprint.simhash(spark.createDataFrame(list(enumerate(texts)), "id long, body string")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts) if t and len(t) >= 200}


def test_dhash():
    assert fingerprint.dhash(bytes(range(9)) * 8, 9, 8) == 0 and fingerprint.dhash(bytes(range(9, 0, -1)) * 8, 9, 8) == -1
    assert fingerprint.dhash(b"", 1, 5) is None and fingerprint.dhash(b"\x09\x01", 2, 1) is not None


def test_sniff():
    s = fingerprint.sniff
    assert [s(None), s(b"", 5), s(b"%PDF-1.4"), s(b"x" * 9 + b"%PDF-"), s(b"PK\x03\x04..word/"), s(b"PK\x03\x04"), s(b"RIFF1234WEBP"), s(b"RIFF1234XXXX")] == ["empty", "binary", "pdf", "pdf", "docx", "zip", "webp", "riff"]
    assert [s(b"\0\0\0\x18ftypM4A "), s(b"\0\0\0\x18ftypisom"), s(b"BM" + b"1" * 20), s(b"BM"), s(b"<?xml ?><svg>"), s(b" \n<!DOCTYPE HTML>"), s("é".encode() * 5), s(b"a\0b"), s(b"\x01\x02abc"), s(b"\xff\xfea\0")] == ["m4a", "mp4", "bmp", "text", "svg", "html", "text", "binary", "binary", "text"]
    assert s(b"\0" * 257 + b"ustar\0") == "tar" and s(b"MSCF") == "cab"


def test_cascade(spark):
    big = b"x" * 20_000
    rows_in = [(1, b"a"), (2, big), (3, big), (4, big[:-1] + b"y"), (5, b"z" * 16_384), (6, None), (7, b"")]
    got = {r["id"]: r for r in fingerprint.hashed(spark.createDataFrame(rows_in, "id long, content binary")).collect()}
    assert got[1]["fhash"] == hashlib.blake2b(b"a", digest_size=32).hexdigest() and got[2]["phash"] == hashlib.blake2b(big[:16384], digest_size=16).hexdigest()
    assert got[2]["fhash"] == got[3]["fhash"] != got[4]["fhash"] is not None and got[5]["fhash"] is None and got[6]["phash"] is None and got[7]["kind"] == "empty"
