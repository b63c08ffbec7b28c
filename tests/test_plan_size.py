"""Plans that a driver of 1.5 GB holds: what is joined several times is computed once."""

import pytest

from attesta.plans import QUERIES

#: Windows in the plan of a query, of which the indicators alone have several.
WINDOWS = {"e11_build_cases": 0, "e12_validate_cases": 0, "e7_verify_conditions": 0}


@pytest.mark.parametrize("name", sorted(WINDOWS))
def test_a_plan_is_small(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") <= WINDOWS[name] and len(plan) < 60_000
