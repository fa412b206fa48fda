"""Plans of the training-data queries: no pair joins, no row-at-a-time Python, [native] without Python."""

import pytest

from tests.test_plans import SF, plan
from threadlake.llm.queries import QUERIES

NATIVE = {"op1_mixing", "op7_chat", "op10_pii"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_pair_joins_and_no_row_python(spark, key):
    text = plan(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if key in NATIVE:
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text
