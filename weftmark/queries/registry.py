"""All queries of the core and their SQL."""

from __future__ import annotations

from weftmark.queries import evaluation, hierarchy, stages

_MODULES = [stages, evaluation, hierarchy]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
