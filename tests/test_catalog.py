"""Every query with SQL gives the SQL's rows; every other query runs and gives rows."""

import pytest

from locusmill.plans.catalog import ORACLES, QUERIES
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 25
    assert rows == sorted(rows, key=lambda r: (r.median_rank, r.tf))


def test_rest_does_not_import_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "locusmill"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "locusmill.llm" not in path.read_text()
