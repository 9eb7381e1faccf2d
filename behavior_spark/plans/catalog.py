"""All named queries and their SQL."""

from behavior_spark.plans import (  # noqa: F401
    ingest_queries,
    model_queries,
    report_queries,
    session_queries,
    storage_queries,
    tracker_queries,
)
from behavior_spark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
