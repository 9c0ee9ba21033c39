"""All registered queries and their SQL oracles."""

from netloom.catalogue import flow_queries, join_queries, table_queries

_MODULES = [flow_queries, join_queries, table_queries]


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
