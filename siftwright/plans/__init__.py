from . import (  # noqa: F401 - registering is the import's purpose
    audit_queries, claim_queries, detector_queries, evaluation_queries, feature_queries, integrity_queries, model_queries, profile_queries, statistics_queries, streaming_queries,
)
from .registry import CHECKS, QUERIES, RESULTS

__all__ = ["CHECKS", "QUERIES", "RESULTS"]
