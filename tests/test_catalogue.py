import pytest

from quillgraph.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(name, spark, sf, duck, check_same):
    check_same(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
