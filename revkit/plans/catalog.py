"""All registered queries (importing each module registers its queries)."""

from revkit.plans import queries  # noqa: F401  (comments)
from revkit.plans import file_queries  # noqa: F401  (D-I)
from revkit.plans import agg_queries  # noqa: F401  (K, L)
from revkit.plans import context_queries  # noqa: F401  (J14, M)
from revkit.plans import request_queries  # noqa: F401  (A4, B)
from revkit.plans import stream_queries  # noqa: F401  (P)
from revkit.plans import report_queries  # noqa: F401  (A6, K7, L6)
from revkit.plans import reply_queries  # noqa: F401  (A7, rejects)
from revkit.plans import typed_queries  # noqa: F401  (A8)
from revkit.plans import extra_queries  # noqa: F401  (A5, L8, M6, Q3)
from revkit.plans.queries import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
