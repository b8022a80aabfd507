"""All registered queries."""

from taskloom.plans import log_queries, session_queries, summary_queries, table_queries  # noqa: F401
from taskloom.plans.registry import ORACLES, QUERIES  # noqa: F401
