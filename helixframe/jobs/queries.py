"""All queries of the library's own operators."""

from helixframe.jobs import alignment_queries, comparison_queries, contact_queries, format_queries, hook_queries, mer_queries, motion_queries  # noqa: F401  they register their queries
from helixframe.jobs.registry import ORACLES, QUERIES  # noqa: F401
