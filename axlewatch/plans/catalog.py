"""All registered queries and their SQL forms."""

from axlewatch.plans import (  # noqa: F401
    alarm_queries, history_queries, label_queries, model_queries, network_queries,
    scoring_queries, stream_queries, window_queries,
)
from axlewatch.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
