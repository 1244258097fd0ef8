"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from plumeria.plans import evaluation, features, intake, judging, matrix, operations, ranking, studies, text, topics  # noqa: F401
from plumeria.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
