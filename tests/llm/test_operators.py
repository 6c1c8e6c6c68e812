import pytest
from oracle import same

from factloom import llm

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    same(llm.queries()[name](spark, SMALL), llm.oracle_sql()[name], SMALL)


def test_ten_operators():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{i}" for i in range(1, 11)]
