"""All registered queries."""

from stipple.plans import graph_queries, qc_queries, stat_queries  # noqa: F401
from stipple.plans.registry import QUERIES, SQL  # noqa: F401
