"""Named queries over the sample tables: name -> (callable, oracle SQL or None)."""

from .queries import QUERIES

__all__ = ["QUERIES"]
