import datetime as dt
import os
import shutil

import pytest

from shelfscan.functions.schedule import parse_hours, task_command, task_hours
from shelfscan.index import Index
from shelfscan.operators.relocate import translate
from shelfscan.sources.sinks import RunLock


def test_an_index_through_its_life(spark, tmp_path):
    root = tmp_path / "r"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("the quick brown fox " * 20)
    (root / "sub" / "b.txt").write_text("the quick brown fox " * 20)
    (root / "c.html").write_text("<p>lazy dog</p>")
    (root / "d.bin").write_bytes(b"\x00\x01")
    i = Index(spark, str(tmp_path / "db"))
    assert i.refresh([str(root)], now=1000.0) == {"new": 5}
    assert i.refresh(now=1001.0) == {"unchanged": 5}
    assert [os.path.basename(r["path"]) for r in i.find("content:dog").collect()] == ["c.html"]
    assert i.search("quick").count() == 2 and i.name("*.bin").count() == 1 and i.name("d.b").count() == 1
    assert i.find("content:dog").collect()[0]["snippet"] == "lazy >>dog<<" and i.search("lazy").collect()[0]["snippet"] == ">>lazy<< dog"
    assert {r["status"] for r in i.files.collect()} == {"ok", "listed", "folder"}
    got = [(r["set"], r["match"], r["name"]) for r in i.dupe_records("exact").collect()]
    assert got == [(1, "identical", "a.txt"), (1, "identical", "b.txt")] and i.dupe_records("name").count() == 0
    assert i.dupes("exact").count() == 2 and i.dupes("near").count() == 2 and i.dupes("name").count() == 0
    before = {r["path"]: (r["id"], r["fhash"], r["simhash"]) for r in i.files.collect()}
    (root / "a.txt").write_text("something else altogether " * 20)
    os.remove(root / "c.html")
    assert i.refresh(now=1002.0) == {"unchanged": 3, "changed": 1, "unseen": 1}
    after = {r["path"]: (r["id"], r["fhash"], r["simhash"]) for r in i.files.collect()}
    a, b = str(root / "a.txt"), str(root / "sub" / "b.txt")
    assert after[a] == (before[a][0], None, None) and after[b] == before[b] and str(root / "c.html") not in after
    assert i.search("quick").count() == 1 and i.search("dog").count() == 0 and i.search("altogether").count() == 1
    i.tree(str(tmp_path / "t.txt"))
    assert "sub/" in (tmp_path / "t.txt").read_text()
    assert i.stats()["totals"].collect()[0]["total"] == 4
    assert i.store.read("postings").where("term = 'quick'").count() == 2  # one is no longer current
    i.vacuum(1)
    assert i.store.read("postings").where("term = 'quick'").count() == 1 and i.search("quick").count() == 1
    i.forget([str(root / "sub")])
    assert i.files.count() == 2 and i.docs.count() == 1
    with RunLock(str(tmp_path / "db" / "run.lock")), pytest.raises(BlockingIOError):
        i.refresh()
    i.clear()
    assert i.files.count() == 0 and i.roots.count() == 1


def test_commands(spark, tmp_path, capsys):
    from shelfscan.__main__ import main

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.txt").write_text("hello there")
    db = ["--db", str(tmp_path / "db")]
    assert main([*db, "index", str(tmp_path / "r")]) == 0
    assert main([*db, "find", "x"]) == 0 and "x.txt" in capsys.readouterr().out
    assert main([*db, "search", "hello", "-o", str(tmp_path / "o.json"), "-f", "json"]) == 0 and (tmp_path / "o.json").exists()
    assert main([*db, "search", "(("]) == 1
    assert main([*db, "dupes", "-o", str(tmp_path / "d.csv")]) == 0 and (tmp_path / "d.csv").read_text().startswith("set,path,name,ext,size,modified,kind,match")
    assert main(["--db", str(tmp_path / "none"), "tree"]) == 2
    assert main([*db, "schedule", "--runs", "1"]) == main([*db, "roots", "--restamp"]) == 0
    assert main([*db, "stats"]) == main([*db, "roots"]) == main([*db, "dupes", "--exact"]) == 0


def test_stored_postings_are_read_by_term(spark, tmp_path):
    """Scores equal those from the texts, and the term is pushed to the scan of the sorted postings."""
    from shelfscan.operators import fts

    root = tmp_path / "r"
    root.mkdir()
    for k in range(12):
        (root / f"{k}.txt").write_text(f"kettle {k} " * (k % 3) + "note word" + str(k) + (" kettle" if k % 5 else ""))
    i = Index(spark, str(tmp_path / "db"))
    i.refresh([str(root)])
    (root / "3.txt").write_text("now the kettle is first")
    i.refresh()
    for query in ("kettle", "kettle note", "note NOT kettle", "word1*", "nothing"):
        plain = {r["id"]: round(r["score"], 9) for r in fts.ranked(i.docs, query).collect()}
        assert {r["id"]: round(r["score"], 9) for r in fts.ranked(i.docs, query, i.stored).collect()} == plain, query
    plan = fts.matching(i.docs, "kettle", i.stored)._jdf.queryExecution().toString()
    assert "EqualTo(term,kettle)" in plan


def test_two_moves_in_a_row(spark, tmp_path):
    """A root whose drive moves twice between mounts of different length ends at the right path each time."""
    i = Index(spark, str(tmp_path / "db"))
    i.store.publish({
        "roots": spark.createDataFrame([("/srv/ledger", 1.0, 2.0, "v", "L", "/srv")], "path string, added double, last_index double, volume_id string, volume_label string, mount string"),
        "files": spark.createDataFrame([(1, "/srv/ledger/a", 0)], "id bigint, path string, is_dir int"),
    }, {"extract_version:/srv/ledger": "2"})
    for mount in ("/m", "/mnt/long/er", "/srv"):
        mounts = spark.createDataFrame([("v", mount, "L")], "volume_id string, mount string, label string")
        plan = i.relocate(mounts, spark.createDataFrame([], "path string")).collect()
        assert [(r["state"], r["new_path"]) for r in plan] == [("moved", f"{mount}/ledger")]
        assert [r["path"] for r in i.files.collect()] == [f"{mount}/ledger/a"]
        assert [(r["path"], r["mount"]) for r in i.roots.collect()] == [(f"{mount}/ledger", mount)] and i.store.get_meta(f"extract_version:{mount}/ledger") == "2"


def test_a_stranger_s_drive_replaces_nothing(spark, tmp_path):
    root = tmp_path / "m" / "r"
    root.mkdir(parents=True)
    (root / "a.txt").write_text("mine")
    i = Index(spark, str(tmp_path / "db"))
    at = lambda v: spark.createDataFrame([(v, str(tmp_path / "m"), "x")], "volume_id string, mount string, label string")
    i.refresh([str(root)], mounts=at("own"))
    i.refresh(mounts=at("own"))
    assert i.roots.collect()[0]["volume_id"] == "own"
    os.remove(root / "a.txt")
    assert i.refresh(mounts=at("other")) == {"unseen": 1} and i.files.count() == 1
    assert i.refresh(mounts=at("own")) == {"unseen": 1} and i.files.count() == 0


def test_live_feed_ends_as_a_rebuild(spark, tmp_path):
    from shelfscan.streaming.watch import IndexFollower, follow

    root = tmp_path / "r"
    (root / "old").mkdir(parents=True)
    (root / "old" / "x.txt").write_text("kettle")
    (root / "a.txt").write_text("first words")
    live = Index(spark, str(tmp_path / "live"))
    live.refresh([str(root)])
    shutil.rmtree(root / "old")
    (root / "a.txt").write_text("second words now")
    (root / "new" / "deep").mkdir(parents=True)
    (root / "new" / "deep" / "y.txt").write_text("deep text")
    follow(live, 0, 1)
    fresh = Index(spark, str(tmp_path / "fresh"))
    fresh.refresh([str(root)])
    rows = lambda i: sorted((r["path"], r["size"], r["status"], r["body"]) for r in i.files.join(i.docs, "id", "left").collect())
    assert rows(live) == rows(fresh) and live.search("second").count() == 1 and live.search("first").count() == live.search("kettle").count() == 0
    # a batch that comes again, a folder's event that walks it, and a deletion of what is still there
    follower, at = IndexFollower(live, "other"), dt.datetime(2024, 1, 1)
    (root / "new" / "z.txt").write_text("late")
    events = spark.createDataFrame([(1, at, "created", str(root / "new"), None, 1), (2, at, "deleted", str(root / "a.txt"), None, 0)], "event_id long, ts timestamp, op string, path string, to_path string, is_dir int")
    follower(events, 0)
    version = live.store.manifest()[0]
    follower(events, 0)
    assert live.store.manifest()[0] == version
    fresh.refresh()
    assert rows(live) == rows(fresh) and live.search("late").count() == 1


def test_pictures(spark, tmp_path):
    import numpy as np

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "p.png").write_bytes(bytes(range(0, 144, 2)))
    (tmp_path / "r" / "q.png").write_bytes(b"short")
    i = Index(spark, str(tmp_path / "db"))
    i.refresh([str(tmp_path / "r")])

    def decode(raw):
        return np.frombuffer(raw, np.uint8, 72)[::-1].tobytes(), 9, 8

    i.fingerprint_images(decode)
    assert {r["name"]: r["dhash"] for r in i.files.where("is_dir = 0").collect()} == {"p.png": -1, "q.png": -(1 << 63)}


def test_schedule_and_translate():
    assert parse_hours("24 hours") == 24 and parse_hours(6) == 6
    for bad in ("", "0h", "1.5h", "x"):
        with pytest.raises(ValueError):
            parse_hours(bad)
    assert task_hours("<Interval>P1DT2H30M</Interval>") == 26.5 and task_hours("<Interval>PT6H</Interval>") == 6 and task_hours(None) is None
    assert task_command("<Command>C:\\a b.exe</Command><Arguments>x &amp; y</Arguments>") == '"C:\\a b.exe" x & y' and task_command("") == ""
    assert translate(["D:\\P", "/b", "/c"], {"d:\\p\\": "E:\\P", "/c/": "/d"}) == ["E:\\P", "/b", "/d"]
