"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from tests.oracle import same
from weft.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        same(df, registry.oracle_sql()[name], SF)
    else:
        assert df.count() == 200
