"""Import every module that registers queries."""

from checks import (cleaning_queries, insight_queries, model_queries,  # noqa: F401
                    request_queries, source_queries)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
