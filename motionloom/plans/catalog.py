"""All registered queries of the library."""

from __future__ import annotations

from . import annotation_queries, circular_queries, cohort_queries, io_queries, motion_queries, pose_queries, segment_queries  # noqa: F401 - they register
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
