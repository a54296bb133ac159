"""The query catalogue: every operator on the driver's tables, with its SQL where SQL can say it."""

from terrashift.plans import evaluation_queries, funnel_queries, kernel_queries, pixel_queries, raster_queries, region_queries, review_queries, stream_queries, table_queries
from terrashift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation_queries", "funnel_queries", "kernel_queries", "pixel_queries", "raster_queries", "region_queries", "review_queries", "stream_queries", "table_queries"]
