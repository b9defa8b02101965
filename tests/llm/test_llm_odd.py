"""Every llm query over empty tables, tables of nulls, and tables with clashing columns."""

import pytest

from shelfscan.llm import queries
from tests.odd_tables import DATA, make, rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    return {kind: make(spark, folder, kind) for kind in ("empty", "null", "clash")}


@pytest.mark.parametrize("kind", ["empty", "null", "clash"])
def test_queries(spark, odd, kind):
    failed = {}
    for name, query in queries.QUERIES.items():
        try:
            got = rows(query(spark, odd[kind]))
            if kind == "clash" and got != rows(query(spark, str(DATA))):
                failed[name] = "other rows"
            if kind != "clash" and got and not name.startswith(("p8", "p9_fill")):
                failed[name] = f"{len(got)} rows"
        except Exception as problem:  # all failures at once
            failed[name] = str(problem)[:300]
    assert not failed, "\n".join(f"{k}: {v}" for k, v in failed.items())
