import re
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfscan.functions import strings as S
from shelfscan.plans import search
from shelfscan.plans.query import Clock, parse

CLOCK = Clock(1772500000.0)


def test_name_terms_follow_like(spark):
    """The column against SQLite's LIKE with an escape, on names and terms of every kind of sign."""
    names = ["report.txt", "REPORT_1%.txt", "rep!ort", "É_a", "é_a", "a_b", "aXb", "", "?*", "İ"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    con = sqlite3.connect(":memory:")
    for term in ["rep", "a_b", "1%", "!", "É", "é", "re*", "*.txt", "?_a", "a?b", "*", "rep!*"]:
        like = re.sub(r"([!%_])", r"!\1", term)
        like = like.replace("*", "%").replace("?", "_") if set("*?") & set(term) else f"%{like}%"
        want = [n for n in names if con.execute("SELECT ? LIKE ? ESCAPE '!'", (n, like)).fetchone()[0]]
        got = [r[0] for r in df.where(search.name_matches(F.col("name"), term)).collect()]
        assert sorted(got) == sorted(want), term


def test_scopes(make_files):
    f = make_files({"path": r"C:\Users\a"}, {"path": "c:\\users"}, {"path": "/Srv/x"}, {"path": "/srv2/x"}, {"path": "\\\\nas\\s\\x"}, {"path": None})
    rows = lambda q: sorted(r[0] for r in search.filtered(f, parse(q, CLOCK)).select("path").collect())
    assert rows("C:") == [r"C:\Users\a", "c:\\users"] and rows(r"c:\USERS\ ") == [r"C:\Users\a"]
    assert rows("/srv /srv2") == ["/Srv/x", "/srv2/x"] and rows(r"\\NAS\s") == ["\\\\nas\\s\\x"]
    assert len(rows("!/srv")) == 4  # the null path passes no negation


def test_order_limit_and_empty(spark, make_files):
    f = make_files({"path": "/x/plan", "mtime": 1.0}, {"path": "/x/plan.txt", "mtime": 2.0}, {"path": "/x/planner", "mtime": 9.0}, {"path": "/x/a plan", "mtime": 10.0}, {"path": "/y/a plan", "mtime": None})
    got = [r["path"] for r in search.find(f, None, "Plan", 0, CLOCK).collect()]
    assert got == ["/x/plan.txt", "/x/plan", "/x/planner", "/x/a plan", "/y/a plan"]
    assert [r["path"] for r in search.find(f, None, "", 2, CLOCK).collect()] == ["/x/a plan", "/x/planner"]
    assert search.find(f.limit(0), spark.createDataFrame([], "id long, body string"), "content:a", 0, CLOCK).count() == 0


def test_negated_ext_drops_null(make_files):
    f = make_files({"ext": None}, {"ext": ""}, {"ext": ".tmp"})
    assert search.filtered(f, parse("!ext:tmp", CLOCK)).count() == 1


def test_pushdown(make_files, spark, tmp_path):
    make_files({"size": 1}).write.parquet(str(tmp_path / "f"))
    plan = search.find(spark.read.parquet(str(tmp_path / "f")), None, "ext:pdf size:>1kb file:", 5, CLOCK)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "IsNotNull(size)" in pushed and "IsNotNull(ext)" in pushed and "TakeOrderedAndProject" in plan


def test_records_and_types(make_files):
    f = make_files({"path": "/a/B.TXT", "size": 3, "mtime": 0.0}, {"path": "C:\\", "is_dir": 1, "size": 0}, {"path": "/a/.bashrc", "size": None}, {"path": "/a/..x.gz"})
    got = {r["path"]: r for r in search.records(f.select("path", "size", "mtime", "is_dir")).collect()}
    assert (got["/a/B.TXT"]["name"], got["/a/B.TXT"]["ext"], got["/a/B.TXT"]["modified"]) == ("B.TXT", ".txt", "")
    assert got["C:\\"]["name"] == "C:\\" and got["C:\\"]["size"] is None and got["C:\\"]["kind"] == "folder"
    assert got["/a/.bashrc"]["ext"] == "" and got["/a/..x.gz"]["ext"] == ".gz" and got["/a/.bashrc"]["size"] == 0 and got["/a/.bashrc"]["modified"] == ""
    more = make_files({"path": "/a/d/", "is_dir": 1}, {"path": "//"}, {"path": "/a/x.pdf", "mtime": 86400.0}, {"path": None})
    got = {r["path"]: (r["name"], r["ext"], r["size"], r["modified"]) for r in search.records(more.select("path", "size", "mtime", "is_dir")).collect()}
    assert got == {"/a/d/": ("d", "", None, ""), "//": ("//", "", 0, ""), "/a/x.pdf": ("x.pdf", ".pdf", 0, "1970-01-02 00:00:00"), None: (None, None, 0, "")}
    assert search.of_type(f, "folders").count() == 1 and search.of_type(f, "").count() == 4 and search.of_type(f, "txt").count() == 4


def test_trigrams_are_no_more_than_a_filter(make_files):
    f = make_files(*({"path": f"/a/{n}"} for n in ("letter", "LETTER.x", "let_ter", "le", "")))
    for term in ("letter", "le", "t_t", "tte", "l*r"):
        want = sorted(r["path"] for r in f.where(search.name_matches(F.col("name"), term)).collect())
        assert sorted(r["path"] for r in search.by_trigrams(f, term).collect()) == want
        assert sorted(r["path"] for r in search.by_trigrams(f, term, search.trigrams(f)).collect()) == want


def test_numbers_and_paths(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (2560,), (1 << 40,), (None,)], "n long")
    assert [r[0] for r in df.select(S.human(F.col("n"))).collect()] == ["0B", "1023B", "2KB", "2KB", "1.0TB", None]
    assert [r[0] for r in df.select(S.human_bytes(F.col("n"))).collect()][:3] == ["0 B", "1023 B", "1.5 KB"]
    p = spark.createDataFrame([(x,) for x in (r"D:\a\b", r"\\nas\share\x", "/a/b", "C:", "rel/x", "//n/s")], "p string")
    got = [(r[0], r[1]) for r in p.select(S.root_part(F.col("p")), S.path_parts(F.col("p"))).collect()]
    assert got == [("D:\\", ["a", "b"]), ("\\\\", ["nas", "share", "x"]), ("/", ["a", "b"]), ("C:\\", []), ("", ["rel", "x"]), ("\\\\", ["n", "s"])]
    q = spark.createDataFrame([("@P seen=1 done=2",), ("x",), (None,)], "l string")
    assert [r[0] for r in q.select(S.progress(F.col("l"))).collect()] == [{"seen": "1", "done": "2"}, None, None]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses(text):
    parse(text, CLOCK)
