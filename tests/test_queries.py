"""Every registered query against its SQL, over whole (small) tables."""

import pytest

from eoframe.plans.catalogue import RUNS, SQL
from oracle import SMALL, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, con, name):
    df = RUNS[name](spark, SMALL)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_a_wrong_query_is_noticed(spark, con):
    df = RUNS["scl_masks"](spark, SMALL)
    assert compare(df, con, SQL["scl_masks"].replace("(3, 8, 9, 10)", "(8, 9, 10)")) != ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
