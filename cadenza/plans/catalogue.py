"""Every registered query of the analytics operators and its SQL."""

from __future__ import annotations

from . import check_queries, evaluation_queries, image_queries, patch_queries, region_queries, timeline_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL, Query

FLAGSHIP = "entity_anomaly_verdict"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
