import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfscan.sources import extract, sinks, walk
from shelfscan.streaming import watch


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_walk(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "node_modules" / "x.js").write_text("x")
    (tmp_path / "a" / "F.TXT").write_text("hello")
    (tmp_path / "b").mkdir()
    (tmp_path / "$trash").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    (tmp_path / "top.md").write_text("")
    got = {r["path"][len(str(tmp_path)) :]: (r["ext"], r["size"], r["is_dir"]) for r in walk.walk(spark, [str(tmp_path), str(tmp_path / "a")]).collect()}
    assert got == {"/a": ("", 0, 1), "/a/F.TXT": (".txt", 5, 0), "/b": ("", 0, 1), "/top.md": (".md", 0, 0)}
    (tmp_path / "deep" / "1" / "2" / "3").mkdir(parents=True)
    for k in range(5):
        (tmp_path / "deep" / "1" / "2" / "3" / f"{k}.txt").write_text("")
    whole = sorted(r["path"] for r in walk.walk(spark, [str(tmp_path)]).collect())
    assert len(whole) == 13 and sorted(r["path"] for r in walk.walk(spark, [str(tmp_path)], most=1).collect()) == whole
    spark.dataSource.register(walk.WalkSource)
    assert spark.read.format("shelfwalk").option("roots", str(tmp_path)).load().count() == 13 and walk.walk(spark, []).count() == 0
    assert [(r["listed"], r["is_dir"]) for r in walk.walk(spark, ["/no/such/folder"]).collect()] == [(0, 1)]


FILES = {
    "a.docx": (pack({"word/document.xml": '<w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t xml:space="p">lo</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p>', "word/header1.xml": "<w:t>head</w:t>", "word/other.xml": "no"}), "head\n Hello \n two"),
    "a.xlsx": (pack({"xl/sharedStrings.xml": "<si><t>one</t></si><si><t>two</t></si>", "xl/worksheets/sheet1.xml": "<c><v>7</v><is><t>in</t></is></c>"}), "one two \n in"),
    "a.pptx": (pack({"ppt/slides/slide1.xml": "<a:p><a:t>S &amp; T</a:t></a:p>", "ppt/slides/rel.xml": "no"}), "S & T"),
    "a.odt": (pack({"content.xml": "<text:p>a<text:s/>b<text:span>c</text:span></text:p>"}), "a bc"),
    "a.epub": (pack({"x.xhtml": '<p><span class="d">T</span>he</p>', "y.css": "no"}), "The"),
    "a.zip": (pack({"in/x.txt": "", "y": ""}), "in/x.txt\ny"),
    "a.html": (b"<html><script>no</script><body>A&eacute;<p>b</p><STYLE>x</STYLE></body>", "Aé b"),
    "a.rtf": (rb"{\rtf1\ansicpg1252 caf\'e9 \u8364?x \u-10179\'3f\u-8704?}", "café €x \U0001f600"),
    "a.doc": (b"\x00\x01Word text here\x00\xff1234\x00\xff" + "Wide text".encode("utf-16-le"), "Wide text\nWord text here"),
    "a.eml": (b"From: a@x\nSubject: =?utf-8?q?H=C3=A9?=\nContent-Type: text/html\n\n<b>hi</b> &amp; you", "From: a@x\nSubject: Hé\n hi & you"),
    "a.txt": ("\ufeffé\r\n\n\n\nx\t y".encode(), "é \n\nx y"),
    "b.txt": ("é".encode("cp1252"), "é"),
    "c.txt": ("é".encode("utf-16"), "é"),
    "d.txt": (b"", ""),
    "e.txt": (None, ""),
}


def test_readers(spark):
    df = spark.createDataFrame([(p, c, "clash") for p, (c, _) in FILES.items()] + [(None, b"x", "")], "path string, content binary, text string")
    got = {r["path"]: r for r in extract.extracted(df).collect()}
    norm = lambda s: " ".join(s.split())
    assert {p: norm(r["text"]) for p, r in got.items()} == {p: norm(t) for p, (_, t) in FILES.items()}
    assert got["d.txt"]["status"] == "empty" and got["a.docx"]["status"] == "ok" and got["b.txt"]["chars"] == 1


def test_errors_are_rows(spark):
    df = spark.createDataFrame([("x.docx", b"no zip"), ("x.pdf", b"%PDF"), ("x.txt", b"a" * 2_000_000)], "path string, content binary")
    got = {r["path"]: r for r in extract.extracted(df).collect()}
    assert got["x.docx"]["status"] == got["x.pdf"]["status"] == "error" and got["x.docx"]["error"].startswith("BadZipFile")
    assert got["x.txt"]["chars"] == 400_000
    extract.PLUGINS[".pdf"] = lambda raw, ext: "read"
    try:
        assert extract.extract("y.pdf", b"x", True) == ("y.pdf", "ok", "ocr", "read")
    finally:
        del extract.PLUGINS[".pdf"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "/a", None), (1, "/b", 2), (2, "/c", 3)], "set int, path string, size long").coalesce(1)
    assert sinks.write_results(df, str(tmp_path / "o.csv"), "csv") == 3
    assert (tmp_path / "o.csv").read_text().splitlines() == ["set,path,size", "1,/a,", "1,/b,2", "2,/c,3"]
    sinks.write_results(df.limit(0), str(tmp_path / "n.json"), "json", "set")
    assert json.loads((tmp_path / "n.json").read_text()) == []
    sinks.write_results(df, str(tmp_path / "o.json"), "json", "set")
    assert [[r["path"] for r in g] for g in json.loads((tmp_path / "o.json").read_text())] == [["/a", "/b"], ["/c"]] and "set" not in (tmp_path / "o.json").read_text()
    sinks.write_results(df, str(tmp_path / "o.txt"), "txt", "set")
    assert (tmp_path / "o.txt").read_text() == "/a\n/b\n\n/c\n"
    with pytest.raises(ValueError):
        sinks.write_results(df, str(tmp_path / "x"), "xml")
    sinks.write_distributed(df, str(tmp_path / "d"), "json")
    assert spark.read.json(str(tmp_path / "d")).count() == 3


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with sinks.RunLock(path):
        with pytest.raises(BlockingIOError):
            sinks.RunLock(path).__enter__()
    (tmp_path / "lock").write_text("999999999")
    with sinks.RunLock(path):
        pass
    assert not os.path.exists(path)
    (tmp_path / "lock").write_text("")  # about to be filled
    with pytest.raises(BlockingIOError):
        sinks.RunLock(path).__enter__()
    os.utime(path, (1, 1))
    with sinks.RunLock(path):
        assert (tmp_path / "lock").read_text() == str(os.getpid())
    assert os.listdir(tmp_path) == []


def test_shared_lock(spark, tmp_path):
    with sinks.SharedLock(spark, f"file://{tmp_path}/lock"), pytest.raises(BlockingIOError):
        sinks.SharedLock(spark, f"file://{tmp_path}/lock").__enter__()
    with sinks.SharedLock(spark, f"file://{tmp_path}/lock"):
        pass


def test_store(spark, tmp_path):
    s = sinks.Store(spark, f"file://{tmp_path}/db")
    with pytest.raises(FileNotFoundError):
        s.read("files")
    s.write("files", spark.range(10).withColumnRenamed("id", "n"))
    before = s.read("files")
    s.write("files", before.where("n > 4"), sort=["n"])
    assert before.count() == 10 and s.read("files").count() == 5
    s.set_meta("k", "1")
    s.set_meta("k", "2")
    assert s.get_meta("k") == "2" and s.get_meta("none") is None
    s.compact("files", 1)
    assert s.read("files").count() == 5 and len([p for p in os.listdir(tmp_path / "db/files") if p.startswith("v-")]) == 1
    s.write("roots", spark.range(1))
    s.clear()
    with pytest.raises(FileNotFoundError):
        s.read("files")
    assert s.read("roots").count() == 1 and s.get_meta("k") is None


def test_a_crash_leaves_what_was_published(spark, tmp_path, monkeypatch):
    """Wherever a run breaks off, all tables are as they were; then the next run goes on."""
    s = sinks.Store(spark, f"file://{tmp_path}/db")
    s.publish({"a": spark.range(1), "b": spark.range(1)}, {"k": "1"})
    whole = (s.version, s._put)

    def broken(*_):
        raise OSError("crash")

    for step in range(3):
        calls = []
        version = lambda t, df, sort=None: broken() if len(calls) == step else calls.append(t) or whole[0](t, df, sort)
        monkeypatch.setattr(s, "version", version)
        monkeypatch.setattr(s, "_put", broken)
        with pytest.raises(OSError):
            s.publish({"a": spark.range(2), "b": spark.range(2)}, {"k": "2"})
        assert (s.read("a").count(), s.read("b").count(), s.get_meta("k")) == (1, 1, "1")
    monkeypatch.undo()
    s.publish({"a": spark.range(2)}, append={"b": spark.range(3)})
    assert (s.read("a").count(), s.read("b").count(), s.get_meta("k")) == (2, 4, "1")
    with pytest.raises(OSError):
        s._put(s.manifest()[0], {})


def test_readers_apart(spark, tmp_path):
    """A reader that crashes or hangs costs its own file; engines are asked in turn."""

    def read(path, recognition):
        if "crash" in path:
            os._exit(1)
        if "hang" in path:
            import time

            time.sleep(60)
        return path, "ok", "", path

    apart = extract.Apart(False, 0.5, read)
    got = [apart(p) for p in ("a", "crash", "b", "hang", "c")]
    apart.close()
    assert [g[1] for g in got] == ["ok", "error", "ok", "error", "ok"] and all(g[2].startswith("extractor ") for g in got if g[1] == "error")
    assert extract.asked([lambda r, e: None, lambda r, e: "", lambda r, e: "x"], b"", ".png") == ""
    with pytest.raises(RuntimeError):
        extract.asked([lambda r, e: None], b"", ".png")
    (tmp_path / "p.pdf").write_bytes(b"words")
    (tmp_path / "q.html").write_bytes(b"<p>page</p>")
    extract.PLUGINS[".pdf"] = lambda raw, ext: raw.decode()
    try:
        df = spark.createDataFrame([(str(tmp_path / n),) for n in ("p.pdf", "q.html", "none.txt")], "path string")
        assert {os.path.basename(r["path"]): (r["status"], r["text"]) for r in extract.read_files(df).collect()} == {"p.pdf": ("ok", "words"), "q.html": ("ok", "page"), "none.txt": ("error", "")}
    finally:
        del extract.PLUGINS[".pdf"]


EVENTS = "event_id long, ts timestamp, op string, path string, to_path string, is_dir int"


def events(spark, n=200):
    rng = random.Random(7)
    import datetime as dt

    rows = []
    for k in range(n):
        folder = rng.random() < 0.1
        path = f"/w/d{rng.randrange(4)}" if folder else f"/w/d{rng.randrange(4)}/f{rng.randrange(6)}"
        rows.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k // 2), rng.choice(["created", "modified", "deleted", "moved"]), path, f"/w/d{rng.randrange(4)}/m{rng.randrange(3)}", int(folder)))
    return spark.createDataFrame(rows + [(n, None, "created", None, None, 0), (n + 1, dt.datetime(2024, 2, 1), "created", "/w/node_modules/x", None, 0)], EVENTS)


def test_fold_takes_the_last_of_each_path(spark):
    got = {r["path"]: r["op"] for r in watch.fold(events(spark)).collect()}
    want, at = {}, {}
    for e in sorted(events(spark).where("ts IS NOT NULL").collect(), key=lambda e: (e["ts"], e["event_id"])):
        if e["op"] == "modified" and e["is_dir"]:
            continue
        for p, o in [(e["path"], "delete"), (e["to_path"], "upsert")] if e["op"] == "moved" else [(e["path"], "delete" if e["op"] == "deleted" else "upsert")]:
            if "node_modules" not in p:
                want[p] = o
    assert got == want


def test_stream_equals_fold_of_folds(spark, tmp_path):
    """The state after the stream is that of folding its batches one after another, and a replayed batch changes nothing."""
    parts = [events(spark).where(F.col("event_id") % 3 == k) for k in range(3)]
    for k, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    follower = watch.Follower(str(tmp_path / "state"), base_every=2)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = follower.start(source, str(tmp_path / "cp"), available_now=True)
    q.awaitTermination()
    last = max(int(p.split("-")[1]) for p in os.listdir(tmp_path / "state") if p.startswith("changes"))
    assert last == 2
    before = sorted(map(tuple, follower.state(spark, last).collect()))
    order = [r[0] for r in sorted((q_["batchId"], 0) for q_ in q.recentProgress)]
    assert order[:3] == [0, 1, 2] and (tmp_path / "state" / "state-1").exists()
    plain = watch.Follower(str(tmp_path / "state"), base_every=99)  # the same without a whole state between
    assert sorted(map(tuple, plain.state(spark, last).collect())) == before
    follower(spark.createDataFrame(follower_input(spark, tmp_path, last), EVENTS), last)
    assert sorted(map(tuple, follower.state(spark, last).collect())) == before


def follower_input(spark, tmp_path, batch):
    """The rows of the batch, from the stream's own log of sources."""
    log = (tmp_path / "cp" / "sources" / "0" / str(batch)).read_text().splitlines()[1:]
    return spark.read.schema(EVENTS).parquet(*[json.loads(x)["path"] for x in log]).collect()


def test_layouts_of_formats():
    w = lambda xml: extract.docx(pack({"word/document.xml": xml})).strip()
    ns = '<?xml version="1.0"?><w:document xmlns:w="x"><w:body>{}</w:body></w:document>'
    assert w(ns.format('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>one</w:t></w:r><w:r><w:t>two &amp; 3</w:t></w:r><w:r><w:tab/><w:t>x</w:t></w:r></w:p><w:p><w:t>next</w:t></w:p>')).split("\n") == ["onetwo & 3 x", "next"]
    assert w("<w:p><w:t>not well-formed &nbsp; <w:t>read</w:p").split() == ["not", "well-formed", "read"]
    assert extract.page(b"<html><p>a<br>b<b>old</b></p><script>if (a < b) {}</script>\n<style>p {}</style>t&auml;t</html>").split() == ["a", "bold", "tät"]
    assert extract.rtf(rb"{\rtf1{\uc2\u8364\'80\'20x}\u233 ?y \{z\}\par\'f6}").split() == ["€x", "éy", "{z}", "ö"]
    mixed = b"MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=b\nSubject: s\n\n--b\nContent-Type: text/html\n\n<p>page</p>\n--b\nContent-Type: text/plain\n\nplain\n--b--\n"
    assert extract.mail(mixed).split() == ["Subject:", "s", "plain"]
    assert extract.scraped(b"") == "" and extract.scraped(b"abc\x00abcd") == "abcd" and extract.scraped("Wide Ω wide".encode("utf-16-le")) == "Wide \n wide"


def test_tree_drawings(spark, make_files):
    from shelfscan.operators import tree

    f = make_files({"path": "/a/b/x.txt", "size": 10}, {"path": "/a/B2", "is_dir": 1}, {"path": "/a/z", "size": None}, {"path": "/c", "size": 2048}, {"path": "D:\\q\\r", "size": 1}, {"path": None})
    assert list(tree.drawing(f)) == [
        "/  [2KB, 3 files]", "├── a/  [10B, 2 files]", "│   ├── b/  [10B, 1 file]", "│   │   └── x.txt  (10B)", "│   ├── B2/  [0B, 0 files]", "│   └── z  (0B)", "└── c  (2KB)", "",
        "D:\\  [1B, 1 file]", "└── q/  [1B, 1 file]", "    └── r  (1B)", "",
    ]
    got = json.loads("".join(tree.as_json(f)))
    assert [r["name"] for r in got] == ["/", "D:\\"] and got[0]["files"] == 3 and [x["name"] for x in got[0]["folders"][0]["folders"]] == ["b", "B2"]
    assert got[0]["items"] == [{"name": "c", "size": 2048}] and got[0]["folders"][0]["items"] == [{"name": "z", "size": 0}] and got[0]["folders"][0]["folders"][1]["items"] == []
    assert json.loads("".join(tree.as_json(f.limit(0)))) == [] and list(tree.drawing(f.limit(0))) == []


def test_sniffed_kinds():
    from shelfscan.operators.fingerprint import sniff

    rows = [
        (b"", 0, "empty"), (b"", 5, "binary"), (b"x%PDF-1.4", 9, "pdf"), (b"PK\x03\x04..word/", 9, "docx"), (b"PK\x03\x04", 4, "zip"), (b"RIFF0000WAVEfmt ", 16, "wav"), (b"RIFF0000ABCD", 12, "riff"), (b"BM" + b"\x01" * 13, 15, "bmp"),
        (b"\x00\x00\x00\x18ftypqt  ", 12, "mov"), (b"\x00\x00\x00\x18ftypisom", 12, "mp4"), (b"\x1f\x8b\x08", 3, "gz"), (b"\x00" * 257 + b"ustar\x00", 263, "tar"), (b"\xef\xbb\xbf<?xml?><SVG>", 9, "svg"),
        (b"<?xml?><a/>", 9, "xml"), (b"  <!DOCTYPE HTML>", 9, "html"), (b"\n<svg>", 9, "svg"), (b"\xff\xfeh\x00", 4, "text"), (b"a\x00b", 3, "binary"), (b"plain", 5, "text"), (b"\x01" * 2 + b"a" * 30, 32, "binary"),
    ]
    assert [sniff(h, s) for h, s, _ in rows] == [k for _, _, k in rows]
