"""What asks for values, units and periods alone reads no pages and judges nothing."""

import pytest

from tallyspark.plans import registry


@pytest.mark.parametrize("name", ["f01_same_answer", "f06_matches_stored_full"])
def test_answers_are_compared_without_pages(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Maturity of borrowings" not in plan
