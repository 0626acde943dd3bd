"""All registered queries."""

from clickloom.catalog import learning, ranking, tables, texts  # noqa: F401
from clickloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
