"""Registered queries and their oracles."""
from . import analytics, basic, corpus, modelling, pages, retrieval, scoring  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
