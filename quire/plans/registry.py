"""Registered queries over the driver's tables and their oracles."""

from . import jobs  # noqa: F401  (registers its queries)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
