"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = [
    "agora.plans.coherence_plans",
    "agora.plans.misc_plans",
    "agora.plans.model_plans",
    "agora.plans.cluster_plans",
    "agora.plans.quality_plans",
    "agora.plans.summary_plans",
    "agora.plans.token_plans",
    "agora.plans.structure_plans",
    "agora.plans.text_plans",
    "agora.plans.graph_plans",
]


def _load():
    qs, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        qs.update(mod.QUERIES)
        sql.update(mod.ORACLE)
    return qs, sql


def all_queries():
    return _load()[0]


def all_oracle_sql():
    return _load()[1]
