import sqlite3

import pytest

from shelfscan.operators import fts

BODIES = [
    "the quick brown fox", "quick the fox, brown!", "a b c d e f g h i j k l m", "foo_bar baz", "naïve café CAFE", "", None, "b a c a b", "don't stop", "x " * 11 + "y",
    "NOT and or", "budget budgets budgetary", "été Été ete", "a x x x x x x x x x x b",
]
QUERIES = [
    "quick", "quick brown", '"quick brown"', "brown + fox", "fox OR baz", "fox NOT brown", "a NOT b OR c", "a OR b NOT c", "(a OR quick) AND fox", "budg*", '"bud" *', "cafe", "NAIVE", "foo_bar", "^ a", "^quick",
    "NEAR(a b)", "NEAR(a b, 9)", "NEAR(b a, 2)", 'NEAR("quick brown" fox, 0)', "NEAR(x y, 10)", "body : fox", "body:fox", "a*b", "not", "a b NOT c", "b NOT a AND c", "a NOT b NOT c", '""', "ete", "a OR b AND c",
]


@pytest.fixture(scope="module")
def sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE docs USING fts5(body, tokenize='unicode61 remove_diacritics 2', prefix='3')")
    con.executemany("INSERT INTO docs(rowid, body) VALUES (?, ?)", [(i, b) for i, b in enumerate(BODIES) if b is not None])
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(BODIES)), "id long, body string").cache()


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_ranks_as_fts5(docs, sqlite, query):
    want = dict(sqlite.execute("SELECT rowid, bm25(docs) FROM docs WHERE docs MATCH ?", (query,)).fetchall())
    got = {r["id"]: r["score"] for r in fts.ranked(docs, query).collect()}
    assert got.keys() == want.keys()
    if "NEAR" not in query:
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("query", ["don't", "a.b", "AND", "-foo", "NOT a", "a AND NOT b", "(a", "a)", "NEAR(a b", "nocol:a", 'a "b', "a OR", ""])
def test_errors_as_fts5(sqlite, query):
    with pytest.raises(sqlite3.OperationalError):
        if query == "":
            raise sqlite3.OperationalError
        sqlite.execute("SELECT 1 FROM docs WHERE docs MATCH ?", (query,)).fetchall()
    with pytest.raises(fts.SyntaxProblem):
        fts.parse(query)


def test_fallback(docs):
    ids = lambda q, **k: sorted(r[0] for r in fts.matching(docs, fts.safe(q, **k)).collect())
    assert ids("don't") == [8] and ids("(quick") == [0, 1] and ids("AND", negative=True) == []
    with pytest.raises(fts.SyntaxProblem):
        fts.safe("AND OR")


def test_vocabulary(docs, sqlite):
    sqlite.execute("CREATE VIRTUAL TABLE IF NOT EXISTS v USING fts5vocab(docs, row)")
    want = {(t, d, c) for t, d, c in sqlite.execute("SELECT term, doc, cnt FROM v")}
    assert {tuple(r) for r in fts.vocabulary(docs).collect()} == want


def test_snippet(docs):
    rows = docs.where("id IN (0, 2)").select(fts.snippet(docs["body"], 'brown OR "g h"', 6)).collect()
    assert rows[0][0] == "the quick >>brown<< fox" and ">>g h<<" in rows[1][0] and rows[1][0].startswith(" ... ")


def test_empty(spark):
    none = spark.createDataFrame([], "id long, body string")
    assert fts.ranked(none, "a").count() == 0 and fts.vocabulary(none).count() == 0


def test_stored_postings_give_the_same(docs):
    held = fts.postings(docs).cache()
    for query in ('"quick brown" OR budg*', "a NOT b OR c", "NEAR(a b, 9)"):
        assert {r["id"]: round(r["score"], 9) for r in fts.ranked(docs, query, held).collect()} == {r["id"]: round(r["score"], 9) for r in fts.ranked(docs, query).collect()}


def test_nothing_moves_but_a_small_file(docs, spark, tmp_path):
    docs.repartition(8).write.parquet(str(tmp_path / "d"))
    plan = fts.matching(spark.read.parquet(str(tmp_path / "d")).repartition(8), "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one asked for here
