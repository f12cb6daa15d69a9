"""All queries of the engine by name, with their DuckDB twins."""

from .plans import cluster, codecs, service, store, upkeep
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cluster", "codecs", "service", "store", "upkeep"]
