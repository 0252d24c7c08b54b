from pathlib import Path

import pytest

import __spark_entry__

from .oracle import compare

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], str(DATA)) is None
