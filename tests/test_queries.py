import pytest
from oracle import same

from factloom import command_queries, graph_queries, more_queries, state_queries  # noqa: F401
from factloom.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL), SQL[name], SMALL)


def test_digest_depends_on_rows_alone(spark):
    a = QUERIES["fact_digest"](spark, SMALL).collect()
    assert len(a) == 1 and len(a[0].digest) == 64
