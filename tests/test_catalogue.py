"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import pytest

from pagemill.plans import catalogue
from tests.compare import database, rows, spark_frame
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    ours = spark_frame(catalogue.queries()[name](spark, SMALL))
    assert len(ours)
    if name in catalogue.oracle_sql():
        theirs = con.execute(catalogue.oracle_sql()[name]).fetchdf().astype(object)
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
