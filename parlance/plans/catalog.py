"""Every query of the library over the driver's tables, and the SQL it must agree with."""

from __future__ import annotations

from parlance.plans import function_queries, meeting_queries, report_queries, segment_queries, stream_queries, transcript_queries  # noqa: F401
from parlance.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
