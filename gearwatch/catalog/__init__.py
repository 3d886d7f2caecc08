"""All registered queries with their oracles."""

from gearwatch.catalog import alerts, detection, features, files, learning, quality, registry, streaming, text  # noqa: F401
from gearwatch.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
