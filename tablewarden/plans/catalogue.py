"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import addresses, detect, fix, models, plant, records, scoring, streams, texts  # noqa: F401  (they register themselves)
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
