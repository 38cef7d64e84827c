"""Dictionary lookups as literal maps: they compile into the generated code
(no join, no shuffle) and unknown / null keys fall back to a default."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.constants import EXPERTISE_RANKS, MEDAL_BOOST


def literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def lookup(mapping: dict, key: Column, default=0) -> Column:
    """``mapping.get(key, default)`` with null keys mapping to ``default``."""
    return F.coalesce(F.element_at(literal_map(mapping), key), F.lit(default))


def expertise_rank(c: Column) -> Column:
    return lookup(EXPERTISE_RANKS, c, 0)


def medal_boost(c: Column) -> Column:
    return lookup(MEDAL_BOOST, c, 0)


def sql_case(mapping: dict, expr: str, default="0") -> str:
    """SQL twin of :func:`lookup` (used by the DuckDB oracle)."""
    whens = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)
