"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from agora.llm import (
    blockrank_queries,
    decontaminate_queries,
    htmltext_queries,
    licences_queries,
    linededup_queries,
    linerules_queries,
    neardup_queries,
    packing_queries,
    ppm_queries,
    prefixhash_queries,
    quality_queries,
    variants_queries,
    warc_queries,
)

_MODULES = [
    decontaminate_queries,
    warc_queries,
    packing_queries,
    licences_queries,
    htmltext_queries,
    ppm_queries,
    prefixhash_queries,
    linededup_queries,
    neardup_queries,
    quality_queries,
    linerules_queries,
    variants_queries,
    blockrank_queries,
]


def all_queries() -> dict:
    out = {"pipeline": corpus_pipeline.run}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def all_oracle_sql() -> dict:
    out = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for m in _MODULES:
        out |= m.ORACLE
    return out
