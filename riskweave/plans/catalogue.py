"""All queries: importing a module registers its own."""

from riskweave.plans import (  # noqa: F401
    evaluation_queries,
    feature_queries,
    flow_queries,
    model_queries,
    rule_queries,
    source_queries,
    text_queries,
)
from riskweave.plans.registry import QUERIES, oracles as ORACLES

__all__ = ["ORACLES", "QUERIES"]
