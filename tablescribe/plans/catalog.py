"""All table queries and their SQL."""

from tablescribe.plans import borders, boxes, headers, numbers, pages, products, queries, rows, rowstates, scores, series, shapes, shear  # noqa: F401  they register themselves
from tablescribe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
