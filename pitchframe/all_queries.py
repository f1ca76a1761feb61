"""All queries of the library outside its optional parts."""

from . import ask_queries, fact_queries, feature_queries, more_queries, name_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
