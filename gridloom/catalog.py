"""All named queries of the grid engine and the SQL they must agree with."""

from __future__ import annotations

from gridloom.plans import association, clustering, grids, polygons, rasters, sampling, spatial, statistics, zonal  # noqa: F401  they register themselves
from gridloom.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
