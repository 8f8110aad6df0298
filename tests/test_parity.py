"""Each query outside the subpackage for training data against its SQL."""

import pytest
from conftest import same_as_sql

from lexatlas.plans import registry


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_parity(spark, db, name):
    same_as_sql(spark, db, name, registry.queries()[name], registry.sql()[name])
