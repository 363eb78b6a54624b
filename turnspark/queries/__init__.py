"""Registered queries over the given tables, each next to its SQL twin where one exists."""

from importlib import import_module

from turnspark.queries.registry import REGISTRY, SQL

MODULES = ["text", "splits", "metrics", "ensembles", "duplicates", "trials", "models", "equations", "experiments", "sources", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"turnspark.queries.{name}")


__all__ = ["REGISTRY", "SQL", "load_all"]
