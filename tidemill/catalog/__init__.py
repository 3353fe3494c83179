"""All registered queries."""

from importlib import import_module

_MODULES = ("row_queries", "shape_queries", "relation_queries", "file_queries", "document_queries", "check_queries", "stream_queries")


def _registry():
    for name in _MODULES:
        import_module(f"tidemill.catalog.{name}")
    return import_module("tidemill.catalog.registry")


def all_queries() -> dict:
    """Query functions ``(spark, folder) -> DataFrame`` by name."""
    return dict(_registry().QUERIES)


def all_oracles() -> dict[str, str]:
    """SQL text by query name."""
    return dict(_registry().ORACLES)
