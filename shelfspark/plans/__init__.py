"""Registered queries of the backlog engine and their SQL."""

from . import intake_oracles, intake_queries, oracles, queries as core, rule_oracles, rule_queries, shelf_queries, state_queries, store_oracles, store_queries


def queries():
    return {**core.queries(), **rule_queries.queries(), **store_queries.queries(), **state_queries.queries(), **intake_queries.queries(), **shelf_queries.queries()}


def oracle_sql():
    return {**oracles.oracle_sql(), **rule_oracles.oracle_sql(), **store_oracles.oracle_sql(), **state_queries.oracle_sql(), **intake_oracles.oracle_sql(), **shelf_queries.oracle_sql()}
