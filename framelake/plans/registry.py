"""All registered queries and their SQL."""

from __future__ import annotations

from . import model_queries, more_queries, network_queries  # noqa: F401  each registers its own
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["m3_gaussian_confusion"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
