import pytest

from tests.oracle import connect, same
from tidemark import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Iterative, learnt or approximate: tested against brute force, on names held out, and against exact figures.
NO_SQL = {"posting_classes", "document_classes", "posting_names", "sketch_drift", "market_match_by_vectors"}


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) - NO_SQL == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, sf_dir, con, name):
    same(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name])
