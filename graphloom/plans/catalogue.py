"""Registered queries of the graph, delta, search and memory operators, with their DuckDB equivalents."""

from __future__ import annotations

from graphloom.plans import context_queries, graph_queries, hash_queries, known_queries, lexical_queries, more_queries, narrative_queries, rule_queries, stateful_queries, table_queries

PARTS = (graph_queries, known_queries, table_queries, rule_queries, more_queries, lexical_queries, stateful_queries, narrative_queries, context_queries, hash_queries)


def queries():
    return {name: f for part in PARTS for name, f in part.FOUND.queries.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.FOUND.sql.items()}
