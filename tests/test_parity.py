"""Every registered query of the study tables equals its SQL on the small tables; those without SQL run and give rows."""

import pytest

from parity import compare, duck
from studyloom.catalog import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(catalog()))
def test_query(spark, con, key):
    item = catalog()[key]
    if item.oracle:
        assert compare(spark, con, SF, item) == ""
    else:
        assert item.run(spark, SF).limit(1).count() == 1
