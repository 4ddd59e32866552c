"""Every registered query and its SQL."""

from __future__ import annotations

from roadspark.plans import areas, pictures, places, relations, rowwise, sequences, shapes, solids, surfaces  # noqa: F401  they register their queries
from roadspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
