"""Each query of the subpackage for training data against its SQL."""

import pytest
from conftest import same_as_sql

from lexatlas.llm import queries


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_parity(spark, db, name):
    same_as_sql(spark, db, name, queries.queries()[name], queries.sql()[name])
