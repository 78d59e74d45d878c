import pytest

from brute import DATA
from tidemark.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, compare, name):
    got, want = compare(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")
    assert got == want
