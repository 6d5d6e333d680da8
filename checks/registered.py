"""The full set of registered queries."""

from . import catalogue_more, catalogue_sources, catalogue_streams  # noqa: F401  (registers)
from .catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
