"""All registered queries and their SQL."""

from __future__ import annotations

from factloom.plans import answering, claims, evaluation, gates, maintenance, profiling, relational, retrieval, sources, temporal, text

MODULES = [relational, text, temporal, maintenance, retrieval, answering, evaluation, claims, gates, sources, profiling]


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
