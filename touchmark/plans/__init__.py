"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

from touchmark.plans import (  # noqa: F401
    catalog,
    data_quality,
    measures,
    paths,
    similarity,
    storage,
)
from touchmark.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
