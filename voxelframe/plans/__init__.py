"""The registered queries of the library."""

from voxelframe.plans import callback_queries, catalog_queries, grid_queries, label_queries, measure_queries, overlap_queries, quality_queries, training_queries  # noqa: F401
from voxelframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
