import pytest
from oracle import connect, differences

from warrantlake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    build, sql = catalogue.QUERIES[name]
    df = build(spark, SF)
    if sql:
        assert differences(df, con, sql) == ""
    else:
        # Compared with plain Python in test_evidence and test_operators.
        assert df.count() > 0
