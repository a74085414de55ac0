"""Every registered query of the reference's operators against its SQL."""

import pytest

from tallyspark.plans import registry
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert not difference(connect(sf), registry.queries()[name](spark, sf), registry.oracle_sql()[name])
