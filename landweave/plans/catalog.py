"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from landweave.plans import lineages, models, overlays, pixels
from landweave.plans.book import Query

BOOKS = (pixels.book, overlays.book, lineages.book, models.book)


def queries() -> dict[str, Query]:
    return {k: v for b in BOOKS for k, v in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for b in BOOKS for k, v in b.sql.items()}
