"""Contracts, and the engine that turns them into columns."""

from .engine import Config, Engine
from .field import array_of, field, union

__all__ = ["Config", "Engine", "array_of", "field", "union"]
