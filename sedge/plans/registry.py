"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

FLAGSHIP = "rrf_hybrid"


def _plans():
    from sedge.plans import documents, events, graph, memory, relational, retrieval, serving, text

    return [documents.PLANS, events.PLANS, graph.PLANS, memory.PLANS, relational.PLANS, retrieval.PLANS, serving.PLANS, text.PLANS]


def queries():
    return {name: run for plans in _plans() for name, (run, _) in plans.items()}


def oracle_sql():
    return {name: sql for plans in _plans() for name, (_, sql) in plans.items() if sql}
