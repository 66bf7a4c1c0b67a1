"""Catalog of the engine's own queries and their SQL twins."""

from . import pieces
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "pieces"]
