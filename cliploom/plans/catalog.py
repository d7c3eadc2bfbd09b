"""All registered queries."""

from __future__ import annotations

from cliploom.plans import batch_queries, decode_queries, file_queries, frame_queries, log_queries, media_queries, run_queries, time_queries  # noqa: F401
from cliploom.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
