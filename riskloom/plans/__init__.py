"""Composed jobs and the registry of named queries."""

from importlib import import_module

QUERY_MODULES = ["scalar", "profile", "window", "label", "model", "graph", "source", "sketch", "composed"]


def load_queries():
    """(queries, SQL twins) with every query module registered."""
    from riskloom.plans import registry

    for name in QUERY_MODULES:
        import_module(f"riskloom.plans.{name}_queries")
    return registry.QUERIES, registry.ORACLES
