"""All queries, by name."""

from . import entities, events, points, signatures, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "entities", "events", "points", "signatures", "texts"]
