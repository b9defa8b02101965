import random

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import change_capture as cc
from shelfscan.operators import incremental as inc
from shelfscan.operators import relocate, tree
from shelfscan.operators.roots import with_root

SCAN = "batch int, path string, name string, ext string, size long, mtime double, is_cloud int, is_dir int, seen double"


def scan(spark, *rows):
    columns = [c.split()[0] for c in SCAN.split(", ")]
    base = {"batch": 1, "ext": ".txt", "size": 1, "mtime": 1.0, "is_cloud": 0, "is_dir": 0, "seen": 10.0}
    return spark.createDataFrame([tuple((base | {"name": (r.get("path") or "").split("/")[-1]} | r).get(c) for c in columns) for r in rows], SCAN)


def roots(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, last_index double")


def test_roots_both_ways(spark):
    r = roots(spark, ("/a", None), ("/a/b", 1.0), ("D:\\x", None), (None, None), ("/a", 2.0))
    paths = ["/a/f", "/a/b/f", "/ab/f", "/a", "D:\\x\\f", "d:\\x\\f", None, "", "/a/b/", "D:\\x/f"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    want = ["/a", "/a/b", None, None, "D:\\x", None, None, None, "/a/b", None]
    for limit in (64, 0):
        got = {x[0]: x[1] for x in with_root(df, r, "path", "root", limit).collect()}
        assert [got[p] for p in paths] == want
    assert with_root(df, r.limit(0), "path", "root").where("root IS NOT NULL").count() == 0


def test_pending(spark, make_files):
    files = make_files(*({"path": f"/r/{k}", "size": 1, "mtime": 1.0, "indexed": i, "status": s} for k, i, s in (("same", 5.0, "ok"), ("late", 20.0, "ok"), ("bad", 5.0, "error"), ("size", 5.0, "ok"), ("null", 5.0, "ok"), ("old", 5.0, "ok"))))
    s = scan(spark, {"path": "/r/same"}, {"path": "/r/late", "size": 9}, {"path": "/r/bad"}, {"path": "/r/size", "size": 2}, {"path": "/r/size", "size": 2}, {"path": "/r/null", "mtime": None}, {"path": "/r/old", "size": 7, "seen": 3.0}, {"path": "/r/new"}, {"path": "/x/none"}, {"path": "/r/dir", "is_dir": 1}, {"path": None}, {"path": "/r/new", "seen": 9.0, "size": 8})
    r = roots(spark, ("/r", 4.0))
    work, log, n = cc.run_pending(s.withColumn("root", F.lit(0)), files.withColumn("seen", F.lit(0)), r)
    assert sorted(x["path"] for x in work.collect()) == ["/r/bad", "/r/new", "/r/null", "/r/size"]
    assert cc.run_pending(s.limit(0), files, r)[0].count() == cc.run_pending(s, files, r.limit(0))[0].count() == 0


def test_a_broken_run_is_replayed(spark, make_files, tmp_path):
    """A run that fails between sink and commit is taken up with its own plan; nothing is skipped or repeated."""
    files, r = make_files(), roots(spark, ("/r", None))
    folder = f"file://{tmp_path}/plans"
    sink = cc.DedupSink(spark, f"file://{tmp_path}/sink")
    first = scan(spark, {"path": "/r/a"}, {"path": "/r/b", "seen": 11.0})
    work, log, n = cc.run_pending(first, files.limit(0), r, folder)
    sink.write(work, n)  # and no commit
    more = first.union(scan(spark, {"path": "/r/c", "seen": 12.0}, {"path": "/r/a", "seen": 12.5, "size": 4}))  # also a newer row of a planned path
    work, log, again = cc.run_pending(more, files.limit(0), r, folder)
    assert again == n and sorted((x["path"], x["seen"]) for x in work.collect()) == [("/r/a", 10.0), ("/r/b", 11.0)]
    sink.write(work, again)
    log.commit(again)
    assert sink.state().count() == 2 and log.offsets() == {"/r": 11.0}
    work, log, third = cc.run_pending(more.union(scan(spark, {"path": "/r/a", "seen": 13.0, "size": 5})), files.limit(0), r, folder)
    assert third == n + 1 and sorted(x["path"] for x in work.collect()) == ["/r/a", "/r/c"]
    sink.write(work, third)
    log.commit(third)
    state = {x["path"]: x["size"] for x in sink.state().collect()}
    assert state == {"/r/a": 5, "/r/b": 1, "/r/c": 1} and log.open_plan() is None
    with pytest.raises(OSError):
        log._write(f"{third}.plan", "[]")


def test_runs_deliver_each_change_once(spark, make_files, tmp_path):
    files, r, folder = make_files(), roots(spark, ("/r", 5.0), ("/n", None)), f"file://{tmp_path}/runs"
    s = scan(spark, {"path": "/r/a", "seen": 4.0}, {"path": "/r/b", "seen": 6.0}, {"path": "/n/c", "seen": 1.0})
    first = cc.run(s, files.limit(0), r, folder)
    assert sorted(x["path"] for x in first.collect()) == ["/n/c", "/r/b"]
    assert cc.run(s, files.limit(0), r, folder).count() == 0
    more = s.union(scan(spark, {"path": "/r/b", "seen": 7.0, "size": 3}))
    assert [(x["path"], x["size"]) for x in cc.run(more, files.limit(0), r, folder).collect()] == [("/r/b", 3)]


def test_ranges_reach_the_scan(spark, tmp_path):
    scan(spark, {"path": "/r/a"}).write.parquet(f"{tmp_path}/scan")
    held = cc.in_ranges(spark.read.parquet(f"{tmp_path}/scan"), roots(spark, ("/r", 3.0)), [{"root": "/r", "after": 3.0, "upto": 12.0}])
    plan = held._jdf.queryExecution().toString()
    assert "GreaterThan(seen,3.0)" in plan and "LessThanOrEqual(seen,12.0)" in plan and held.count() == 1


def test_classify(spark, make_files):
    files = make_files({"path": "/u", "size": 1, "mtime": 1.0}, {"path": "/c", "size": 2, "mtime": 1.0}, {"path": "/l", "size": 1, "mtime": 1.0, "status": "listed"}, {"path": "/e", "size": 1, "mtime": 1.0, "status": "error", "error": "X"}, {"path": "/x", "size": 1, "mtime": 1.0, "status": "error", "error": "extractor died"}, {"path": "/gone"}, {"path": "/n", "size": None, "mtime": None})
    s = scan(spark, {"path": "/u", "mtime": 1.0000005}, {"path": "/c"}, {"path": "/l"}, {"path": "/e"}, {"path": "/x"}, {"path": "/new"}, {"path": "/n", "size": None, "mtime": None})
    got = {r[0]: r[1] for r in inc.classify(s, files).collect()}
    assert got == {"/u": "unchanged", "/c": "changed", "/l": "newly-eligible", "/e": "retry", "/x": "unchanged", "/gone": "unseen", "/new": "new", "/n": "unchanged"}
    assert {r[1] for r in inc.classify(s, files, rebuild=True).collect()} == {"changed", "new", "unseen"}


def test_upsert_keeps_and_drops_fingerprints(spark, make_files):
    old = {"size": 1, "mtime": 1.0, "chars": 3, "phash": "p", "fhash": "f", "kind": "k", "simhash": 5, "dhash": 6}
    files = make_files(*({"path": p} | old for p in ("/same", "/chars", "/size", "/kept")))
    new = spark.createDataFrame([("/same", "n", ".e", 1, 1.0, 9.0, 3, "ok", "", 0), ("/chars", "n", ".e", 1, 1.0, 9.0, 4, "ok", "", 0), ("/size", "n", ".e", 2, 1.0, 9.0, 3, "ok", "", 0), ("/b", "b", ".e", 2, 1.0, 9.0, 3, "ok", "", 0), ("/a", "a", ".e", 2, 1.0, 9.0, 3, "ok", "", 0), ("/a", "a", ".e", 7, 1.0, 10.0, 3, "ok", "", 0)], "path string, name string, ext string, size long, mtime double, indexed double, chars long, status string, error string, is_dir int")
    got = {r["path"]: r for r in inc.upsert(files, new).collect()}
    assert len(got) == 6 and got["/same"]["simhash"] == 5 and got["/same"]["name"] == "same" and got["/kept"]["fhash"] == "f"
    assert (got["/chars"]["simhash"], got["/chars"]["fhash"]) == (None, "f") and (got["/size"]["fhash"], got["/size"]["dhash"]) == (None, None)
    assert (got["/a"]["id"], got["/a"]["size"], got["/b"]["id"]) == (5, 7, 6)


def test_refresh_twice_changes_nothing(spark, make_files):
    rng = random.Random(2)
    walk = scan(spark, *({"path": f"/r/{k}", "size": rng.randrange(5), "mtime": rng.random()} for k in range(30)))
    files = inc.upsert(make_files().limit(0), inc.name_only(walk, 1.0))
    done = inc.upsert(files, inc.name_only(walk, 1.0))
    assert done.exceptAll(files).count() == 0
    assert {r[1] for r in inc.classify(walk.withColumn("is_cloud", F.lit(1)), files).collect()} == {"unchanged"}


def test_prune_and_forget(spark, make_files):
    files = make_files({"path": "/r/a"}, {"path": "/r/blind/b"}, {"path": "/other/c"}, {"path": "/r/d", "is_dir": 1}, {"path": "/r/d/e"}, {"path": "/r/dd"})
    walk, r = scan(spark, {"path": "/r/a"}), spark.createDataFrame([("/r",)], "path string")
    blind = spark.createDataFrame([("/r/blind",)], "path string")
    assert sorted(x["path"] for x in inc.prune(files, walk, r, blind).collect()) == ["/other/c", "/r/a", "/r/blind/b"]
    assert sorted(x["path"] for x in inc.forget(files, spark.createDataFrame([("/r/d",), ("/r/a",), (None,)], "path string")).collect()) == ["/other/c", "/r/blind/b", "/r/dd"]


def test_denest_and_roots(spark):
    r = spark.createDataFrame([("/a", 1.0, None), ("/A/b", 2.0, 5.0), ("/ab", 3.0, None), ("D:\\x", 3.0, None), ("d:\\X\\y", 3.0, None), ("/", 1.0, None)], "path string, added double, last_index double")
    assert sorted(x[0] for x in inc.denest(r.where("path <> '/'")).collect()) == ["/a", "/ab", "D:\\x"]
    w = spark.createDataFrame([("/a",), ("/new",)], "path string")
    got = {x["path"]: (x["added"], x["last_index"]) for x in inc.merge_roots(r, w, 9.0, True).collect()}
    assert got["/a"] == (1.0, 9.0) and got["/new"] == (9.0, 9.0) and got["/A/b"] == (2.0, 5.0)
    got = {x["path"]: (x["added"], x["last_index"]) for x in inc.set_roots(r, w, 9.0).collect()}
    assert got == {"/a": (1.0, None), "/new": (9.0, None)}


def test_moves_that_swap(spark, make_files):
    files = make_files({"path": r"D:\p\a"}, {"path": r"E:\s\b"}, {"path": r"E:\p\stale"}, {"path": "/keep"}, {"path": r"D:\p"}, {"path": r"D:\pq\x"})
    moves = spark.createDataFrame([("D:\\p", "E:\\p"), ("E:\\s\\", "D:\\s"), ("/none", None)], "path string, new_path string")
    assert sorted(r["path"] for r in relocate.move(files, moves).collect()) == ["/keep", r"D:\pq\x", r"D:\s\b", r"E:\p", r"E:\p\a"]
    whole = spark.createDataFrame([("D:\\", "F:\\")], "path string, new_path string")
    assert sorted(r["path"] for r in relocate.move(files, whole).collect())[3:] == [r"F:\p", r"F:\p\a", r"F:\pq\x"]


def test_tree(spark, make_files):
    files = make_files({"path": "/a/b/c.txt", "size": 1024}, {"path": "/a/B2", "is_dir": 1}, {"path": "/a/d.txt", "size": None}, {"path": r"D:\x", "size": 3}, {"path": None, "size": 9})
    got = {(r["root"], r["folder"]): (r["size"], r["files"]) for r in tree.rollup(files).collect()}
    assert got == {("/", ""): (1024, 2), ("/", "a"): (1024, 2), ("/", "a/b"): (1024, 1), ("/", "a/B2"): (0, 0), ("D:\\", ""): (3, 1)}
    assert list(tree.drawing(files)) == ["/  [1KB, 2 files]", "└── a/  [1KB, 2 files]", "    ├── b/  [1KB, 1 file]", "    │   └── c.txt  (1KB)", "    ├── B2/  [0B, 0 files]", "    └── d.txt  (0B)", "", "D:\\  [3B, 1 file]", "└── x  (3B)", ""]
    assert '"items"' in "".join(tree.as_json(files)) and tree.listing(files, "/a/").count() == 3 and tree.rollup(files.limit(0)).count() == 0
