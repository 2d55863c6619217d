import pytest

from tests.oracle import connect, same
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    assert same(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLES[name]) > 0


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
