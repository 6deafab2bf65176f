"""Plan invariants for every query of the catalog.

* No all-pairs join: a cartesian product or a nested-loop join pairs every row of one side
  with every row of the other. Every join in the library is an equi-join (null-safe keys
  included), so neither operator may appear in any physical plan.
* No row-at-a-time Python: Python runs only as Arrow-batched pandas UDFs, ``mapInPandas``
  or cogroups, never as ``BatchEvalPython``."""

import pytest

from sparkqa import catalog
from conftest import SF_SMALL

ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")
ROW_PYTHON = "BatchEvalPython"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_all_pairs_join(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in ALL_PAIRS if op in plan], plan
    assert ROW_PYTHON not in plan, plan
