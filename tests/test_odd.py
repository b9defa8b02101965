"""Every query of the core over empty tables, tables of nulls, and tables with clashing columns."""

import pytest

from shelfscan.plans import catalog
from tests.odd_tables import DATA, make, rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
ENVIRONMENT = {"scan_files"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    return {kind: make(spark, folder, kind) for kind in ("empty", "null", "clash")}


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_nothing_crashes(spark, odd, kind):
    failed = {}
    for name, query in catalog.QUERIES.items():
        try:
            query(spark, odd[kind]).collect()
        except Exception as problem:  # all failures at once
            failed[name] = str(problem)[:200]
    assert not failed


def test_more_columns_change_nothing(spark, odd):
    changed = {}
    for name, query in catalog.QUERIES.items():
        try:
            if name not in ENVIRONMENT and rows(query(spark, odd["clash"])) != rows(query(spark, str(DATA))):
                changed[name] = "other rows"
        except Exception as problem:  # all failures at once
            changed[name] = str(problem)[:200]
    assert not changed, "\n".join(f"{k}: {v}" for k, v in changed.items())
