"""Queries on printed rules, made of the columns of part: a part is a rule, a page is a brand's parts in 2,000 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescribe.operators import borders
from tablescribe.plans.boxes import PAGE
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

# The same expressions in both dialects: pieces of rules at 30 places of either kind, some through the page, some short.
_AT, _FROM, _LONG = "(p_size % 30 * 30 + p_partkey % 3) * 1.0D", "(p_partkey * 7 % 13 * 40) * 1.0D", "(CASE WHEN p_partkey % 5 = 0 THEN 600 ELSE 60 + p_partkey % 9 * 10 END)"
RULE = (
    PAGE, "p_partkey AS id", "p_partkey % 2 = 0 AS flat", f"CASE WHEN p_partkey % 2 = 0 THEN {_FROM} ELSE {_AT} END AS x0", f"CASE WHEN p_partkey % 2 = 0 THEN {_AT} ELSE {_FROM} END AS y0",
    f"CASE WHEN p_partkey % 2 = 0 THEN {_FROM} + {_LONG} ELSE {_AT} END AS x1", f"CASE WHEN p_partkey % 2 = 0 THEN {_AT} ELSE {_FROM} + {_LONG} END AS y1",
)
CROSS_SQL = f"""r AS (SELECT {", ".join(RULE).replace("1.0D", "1.0::DOUBLE")} FROM part),
x AS (SELECT h.page, h.id AS h, v.id AS v, v.x0 AS x, h.y0 AS y FROM r h JOIN r v ON h.page = v.page AND h.flat AND NOT v.flat AND v.x0 BETWEEN h.x0 - 4 AND h.x1 + 4 AND h.y0 BETWEEN v.y0 - 4 AND v.y1 + 4)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*RULE)


@query(f"WITH {CROSS_SQL} SELECT page, h, v, x, y FROM x")
def border_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return borders.crossings(_rules(spark, sf_dir), ["page"], 4.0, 100.0)


@query(f"""
WITH RECURSIVE {CROSS_SQL}, e AS (SELECT h AS a, v AS b FROM x UNION SELECT v, h FROM x),
c(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b), g AS (SELECT node AS id, least(min(root), node) AS grid FROM c GROUP BY node),
b AS (SELECT page, grid, count(*) FILTER (flat) AS flats, count(*) FILTER (NOT flat) AS steeps, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r JOIN g USING (id) GROUP BY 1, 2),
n AS (SELECT grid, count(*) AS crossings FROM x JOIN g ON g.id = x.h GROUP BY 1)
SELECT page, grid, flats, steeps, crossings, x0, y0, x1, y1, row_number() OVER (PARTITION BY page ORDER BY crossings DESC, (x1 - x0) * (y1 - y0) DESC, grid) AS nth FROM b JOIN n USING (grid) WHERE flats >= 2 AND steeps >= 2""")
def border_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.sources.scratch import written

    rules = _rules(spark, sf_dir)
    return borders.grids(rules, written(borders.crossings(rules, ["page"], 4.0, 100.0)), ["page"])


@query(None)
def border_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, sections, rows and columns of each page's first grid; tests hold sections against known pages."""
    from tablescribe.sources.scratch import written

    rules = _rules(spark, sf_dir)
    return borders.layouts(rules, written(borders.crossings(rules, ["page"], 4.0, 100.0)), ["page"], 900.0, 4.0)
