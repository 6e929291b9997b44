"""Every query of the library against its SQL, as the driver does; the others must run and have stable columns."""

import pytest

import oracle
import textloom.queries as library


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_against_sql(spark, sf_dir, con, name):
    assert oracle.difference(library.QUERIES[name](spark, sf_dir), con, library.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, sf_dir, name):
    first, second = library.QUERIES[name](spark, sf_dir), library.QUERIES[name](spark, sf_dir)
    assert first.schema == second.schema and first.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
