"""Helpers shared by the query plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND = 6


def r6(c) -> Column:
    """Doubles are compared after rounding to 6 places (both engines)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), ROUND) + F.lit(0.0)


def R(expr: str, places: int = ROUND) -> str:
    """SQL twin of :func:`r6`; ``+ 0.0`` folds -0.0 into 0.0."""
    return f"(round({expr}, {places}) + 0.0)"


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body
