"""The full query catalogue: importing this module registers every query."""

from __future__ import annotations

import importlib

from postlens.plans.registry import ORACLE, QUERIES

_MODULES = [
    "postlens.plans.q_timeseries",
    "postlens.plans.q_text",
    "postlens.plans.q_sampling",
    "postlens.plans.q_labels",
    "postlens.plans.q_evaluate",
    "postlens.plans.q_ingest",
    "postlens.plans.q_vectors",
    "postlens.plans.q_streaming",
    "postlens.plans.q_classify",
]

for _m in _MODULES:
    importlib.import_module(_m)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
