import pytest

from quillspark import catalog
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.SQL:
        assert not differences(df, con, catalog.SQL[name])
    else:
        df.collect()
