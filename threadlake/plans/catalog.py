"""All registered queries."""

from __future__ import annotations

from threadlake.plans import (  # noqa: F401
    activity_queries, retrieval_queries, stream_queries, warehouse_queries,
)
from threadlake.plans.registry import ORACLES, QUERIES  # noqa: F401
