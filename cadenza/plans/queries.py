"""All queries of the library but those of the language-model operators."""

from . import catalogue, keys, retag
from .adapters import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "keys", "retag"]
