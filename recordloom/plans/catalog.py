"""Registry of the engine's own queries and their SQL equivalents."""

from __future__ import annotations

from . import comparing, generating, linking, reading, scoring_queries, values

MODULES = (comparing, linking, scoring_queries, generating, values, reading)


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
