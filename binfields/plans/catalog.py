"""All queries of the library proper and their SQL."""

from binfields.plans import grid_queries, model_queries, space_queries, statistic_queries, wide_queries  # noqa: F401  each module registers its queries
from binfields.plans.fixture import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
