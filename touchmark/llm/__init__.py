"""Operators for text corpora, each with its registered query."""

from __future__ import annotations

from touchmark.llm import (  # noqa: F401
    alignment,
    bpe,
    decontamination,
    html,
    licenses,
    lines,
    privacy,
    quality,
    sharding,
    simhash,
    token_counts,
    topk,
    whitening,
)
from touchmark.llm.common import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
