"""Every registered query with an oracle equals DuckDB on the smallest data folder."""
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
# the optional training-data queries (op…, pipeline) have tests of their own
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.startswith("q")))
def test_equals_oracle(spark, con, name):
    assert check.compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if n.startswith("q")))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
