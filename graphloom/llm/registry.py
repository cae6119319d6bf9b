"""Registered queries of the training-data operators: one opN_<name> each, over whole tables."""

from __future__ import annotations

from graphloom.llm import op_queries


def queries():
    return {k: f for k, f in vars(op_queries).items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql():
    return dict(op_queries.ORACLE_SQL)
