"""All registered queries."""

from layerweave.plans import (  # noqa: F401
    class_queries, community_queries, edge_queries, factor_queries, graph_queries, incremental_queries, job_queries, people_queries, score_queries, table_queries, tensor_queries,
)
from layerweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
