"""The llm queries over the smallest scale, against SQL where there is some."""

from pathlib import Path

import pytest

from shelfscan.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name in queries.SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(queries.SQL[name])
        at = [df.columns.index(c[0]) for c in cur.description]
        assert sorted(tuple(r[i] for i in at) for r in rows) == sorted(cur.fetchall())


def test_found_columns(spark):
    want = {"p1_found": ["id"], "p2_found": ["id", "group_id"], "p3_found": ["group_id", "keep_id"], "p4_found": ["id_a", "id_b"], "p6_found": ["field", "id_a", "id_b"], "p7_found": ["id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, str(DATA)).columns == columns
