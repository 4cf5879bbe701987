"""Runnable queries over the driver's tables, each with its check SQL."""

from __future__ import annotations

from emberfield.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    joins,
    models,
    projections,
    quality,
    sources,
    streams,
)
from emberfield.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
