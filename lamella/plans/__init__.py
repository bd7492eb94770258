"""Named queries over the derived fixtures, with their SQL."""

from lamella.plans import catalog_queries, codec_queries, container_queries, planning_queries, tile_queries  # noqa: F401
from lamella.plans.registry import ORACLE_SQL as SQL
from lamella.plans.registry import QUERIES

__all__ = ["QUERIES", "SQL"]
