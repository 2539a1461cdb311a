"""Registered queries: every operator run on the given tables, with SQL to check it."""

from wayfold.registry.base import REGISTRY, Query  # noqa: F401


def load() -> dict[str, Query]:
    from wayfold.registry import commerce, logs, operations, sites, streams, texts  # noqa: F401
    return REGISTRY
