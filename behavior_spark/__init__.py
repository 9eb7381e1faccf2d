"""Website behaviour analytics on Spark tables and streams."""

from behavior_spark.operators import (
    features,
    ingest,
    ml,
    quality,
    reports,
    scoring,
    tracker,
)
from behavior_spark.session import get_session
from behavior_spark.sources import tables

__all__ = [
    "features",
    "get_session",
    "ingest",
    "ml",
    "quality",
    "reports",
    "scoring",
    "tables",
    "tracker",
]
