"""Queries on boxes, made of the columns of part: a part is a box of 40 by 60, a page is a brand or a brand's parts in 2,000 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.operators import boxes, graph, joins
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

# The same expressions in both dialects.
PAGE = "p_brand || '-' || CAST(CAST(floor(p_partkey / 2000) AS BIGINT) AS STRING) AS page"
BOX = f"{PAGE}, p_partkey AS id, p_size * 4.0D AS x0, p_retailprice - 900 AS y0, p_size * 4.0D + 40 AS x1, p_retailprice - 900 + 60 AS y1, p_size % 7 / 7.0D AS confidence, p_name AS text"
MOVED = f"{PAGE}, p_partkey AS id, p_size * 4.0D + p_partkey % 9 AS x0, p_retailprice - 900 + p_partkey % 13 AS y0, p_size * 4.0D + 40 + p_partkey % 9 AS x1, p_retailprice - 840 + p_partkey % 13 AS y1"
BOX_SQL = f"(SELECT {BOX.replace('0D', '0::DOUBLE')} FROM part)"
MOVED_SQL = f"(SELECT {MOVED.replace('0D', '0::DOUBLE')} FROM part)"
# Where a query's pages are whole brands, however many parts they have.
BRAND = "p_brand AS page"
BRAND_BOX, BRAND_MOVED = BOX.replace(PAGE, BRAND), MOVED.replace(PAGE, BRAND)
BRAND_BOX_SQL, BRAND_MOVED_SQL = BOX_SQL.replace(PAGE, BRAND), MOVED_SQL.replace(PAGE, BRAND)
CELL_SQL = f"(SELECT DISTINCT {PAGE}, r AS row, c AS col, c * 55.0::DOUBLE AS x0, r * 300.0::DOUBLE AS y0, c * 55.0::DOUBLE + 50 AS x1, r * 300.0::DOUBLE + 250 AS y1 FROM part, (SELECT range::INT AS r FROM range(4)), (SELECT range::INT AS c FROM range(5)))"
IOU_SQL = """(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))
 / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"""


def _boxes(spark: SparkSession, sf_dir: str, what: str = BOX) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[c.strip() for c in what.split(", ")])


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").selectExpr(PAGE).distinct()
    grid = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row")).select("page", "row", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col"))
    return grid.selectExpr("page", "row", "col", "col * 55.0D AS x0", "row * 300.0D AS y0", "col * 55.0D + 50 AS x1", "row * 300.0D + 250 AS y1")


@query(f"""
WITH w AS (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {BOX_SQL})
SELECT c.page, c.row, c.col, count(*) AS words, string_agg(w.text, ' ' ORDER BY w.y0, w.x0, w.text) AS text FROM {CELL_SQL} c JOIN w ON w.page = c.page AND x >= c.x0 AND x < c.x1 AND y >= c.y0 AND y < c.y1 GROUP BY 1, 2, 3""")
def text_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.text_of_cells(_boxes(spark, sf_dir), _cells(spark, sf_dir), ["page"], ["row", "col"], "text", 50.0)


@query(f"""
SELECT a.page, a.row, a.col, round(avg(b.confidence), 6) AS mean FROM {CELL_SQL} a LEFT JOIN {BOX_SQL} b ON a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY 1, 2, 3""")
def overlap_mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.overlap_mean(_cells(spark, sf_dir), _boxes(spark, sf_dir), ["page"], ["row", "col"], "confidence", 50.0)
    return found.withColumn("mean", F.round("mean", 6))


@query(f"""
SELECT b.page, b.id FROM {BOX_SQL} b WHERE NOT EXISTS (SELECT 1 FROM {CELL_SQL} c WHERE c.page = b.page AND c.col = 0 AND b.y0 >= c.y0 AND b.y0 < c.y0 + 60)""")
def lines_outside_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.outside_ranges(_boxes(spark, sf_dir), "y0", _cells(spark, sf_dir).where("col = 0").withColumn("end", F.col("y0") + 60), "y0", "end", ["page"], 250.0).select("page", "id")


@query(f"""
WITH b AS (SELECT page, id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {BOX_SQL}),
c AS (SELECT b.page, b.id, c.col, abs(b.x - (c.x0 + c.x1) / 2) AS d FROM b JOIN {CELL_SQL} c ON c.page = b.page AND c.row = 0 QUALIFY row_number() OVER (PARTITION BY b.page, b.id ORDER BY d, c.col) = 1),
r AS (SELECT b.page, b.id, c.row, abs(b.y - (c.y0 + c.y1) / 2) AS d FROM b JOIN {CELL_SQL} c ON c.page = b.page AND c.col = 0 QUALIFY row_number() OVER (PARTITION BY b.page, b.id ORDER BY d, c.row) = 1)
SELECT page, id, CASE WHEN r.d <= 120 THEN row END AS row, CASE WHEN c.d <= 20 THEN col END AS col FROM c JOIN r USING (page, id)""")
def nearest_row_and_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).selectExpr("page", "id", "(x0 + x1) / 2 AS x", "(y0 + y1) / 2 AS y")
    cells = _cells(spark, sf_dir).selectExpr("page", "row", "col", "(x0 + x1) / 2 AS cx", "(y0 + y1) / 2 AS cy")
    by_col = boxes.nearest_centre(words, "x", cells.where("row = 0"), "cx", "col", ["page"], "col", 20.0)
    return boxes.nearest_centre(by_col, "y", cells.where("col = 0"), "cy", "row", ["page"], "row", 120.0).select("page", "id", "row", "col")


@query(f"""
SELECT a.page, a.id, count(b.id) AS near FROM {BRAND_BOX_SQL} a LEFT JOIN {BRAND_BOX_SQL} b ON a.page = b.page AND a.id <> b.id AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 900 GROUP BY 1, 2""")
def points_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.within_radius(_boxes(spark, sf_dir, BRAND_BOX).selectExpr("page", "id", "x0 AS x", "y0 AS y"), ["page"], "id", 30.0)


@query(f"""
SELECT a.page, a.id, b.id AS neighbour, b.x0 - a.x1 AS gap FROM {BRAND_BOX_SQL} a JOIN {BRAND_BOX_SQL} b ON a.page = b.page AND a.id <> b.id AND b.x0 - a.x1 BETWEEN 0 AND 60 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)
QUALIFY row_number() OVER (PARTITION BY a.page, a.id ORDER BY gap, b.id) = 1""")
def right_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.right_neighbour(_boxes(spark, sf_dir, BRAND_BOX).select("page", "id", *boxes.SIDES), ["page"], "id", 60.0)


@query(f"""
WITH p AS (SELECT a.page, a.id AS a, b.id AS b FROM {BRAND_BOX_SQL} a JOIN {BRAND_MOVED_SQL} b ON a.page = b.page AND {IOU_SQL} > 0.3)
SELECT t.page, 'truth' AS side, t.id, count(p.b) AS n FROM {BRAND_BOX_SQL} t LEFT JOIN p ON p.page = t.page AND p.a = t.id GROUP BY 1, 3 UNION ALL
SELECT t.page, 'found' AS side, t.id, count(p.a) AS n FROM {BRAND_MOVED_SQL} t LEFT JOIN p ON p.page = t.page AND p.b = t.id GROUP BY 1, 3""")
def split_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.split_and_merge(_boxes(spark, sf_dir, BRAND_BOX).select("page", "id", *boxes.SIDES), _boxes(spark, sf_dir, BRAND_MOVED), ["page"], "id", 0.3, 50.0)


@query(f"""
SELECT a.page, a.id, min(b.id) AS block FROM {BRAND_BOX_SQL} a LEFT JOIN {BRAND_MOVED_SQL} b ON a.page = b.page AND {IOU_SQL} > 0.1 GROUP BY 1, 2""")
def first_block_by_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.first_block(_boxes(spark, sf_dir, BRAND_BOX).select("page", "id", *boxes.SIDES), _boxes(spark, sf_dir, BRAND_MOVED), ["page"], "id", 0.1, 50.0)


@query(f"""
WITH b AS (SELECT a.page, a.id, max({IOU_SQL}) AS best FROM {BRAND_BOX_SQL} a JOIN {BRAND_MOVED_SQL} b ON a.page = b.page GROUP BY 1, 2)
SELECT page, count(*) AS boxes, round(avg(coalesce(best, 0)), 6) AS mean FROM {BRAND_BOX_SQL} LEFT JOIN b USING (page, id) GROUP BY 1""")
def mean_best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.best_iou(_boxes(spark, sf_dir, BRAND_BOX).select("page", "id", *boxes.SIDES), _boxes(spark, sf_dir, BRAND_MOVED), ["page"], "id", 50.0)
    return found.withColumn("mean", F.round("mean", 6))


@query("""
SELECT l_suppkey AS label, min(l_partkey) AS x0, min(l_quantity) AS y0, max(l_partkey) + 1 AS x1, max(l_quantity) + 1 AS y1, count(*) AS area, round(avg(l_partkey), 6) AS cx, round(avg(l_quantity), 6) AS cy FROM lineitem GROUP BY 1""")
def component_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS label", "l_partkey AS x", "l_quantity AS y")
    return boxes.bounds(points, ["label"]).withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query(f"SELECT page, id % 5 AS row, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS boxes FROM {BOX_SQL} GROUP BY 1, 2")
def union_box_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.union_box(_boxes(spark, sf_dir).withColumn("row", F.col("id") % 5), ["page", "row"])


NARROW = f"{PAGE}, p_partkey AS id, p_size * 8.0D AS x0, p_size * 8.0D + 9 AS x1"
NARROW_SQL = f"(SELECT {PAGE}, p_partkey AS id, p_size * 8.0::DOUBLE AS x0, p_size * 8.0::DOUBLE + 9 AS x1 FROM part)"
COVER_SQL = f"""(WITH e AS (SELECT page, x0 AS x FROM {NARROW_SQL} UNION SELECT page, x1 FROM {NARROW_SQL}), s AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS until FROM e)
SELECT s.page, s.x, s.until, count(b.id) AS covered FROM s LEFT JOIN {NARROW_SQL} b ON b.page = s.page AND b.x0 <= s.x AND b.x1 > s.x WHERE until IS NOT NULL GROUP BY 1, 2, 3)"""
BRAND_NARROW, BRAND_COVER_SQL = NARROW.replace(PAGE, BRAND), COVER_SQL.replace(PAGE, BRAND)


@query(f"SELECT page, x, until, covered FROM {BRAND_COVER_SQL}")
def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches on which the number of boxes doesn't change; places where as many start as end stay places."""
    return boxes.coverage(_boxes(spark, sf_dir, BRAND_NARROW), ["page"], "x0", "x1")


GUTTER_SQL = f"""(WITH c AS (SELECT *, covered <= 0 AS clear FROM {COVER_SQL}), r AS (SELECT *, sum(CASE WHEN clear AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x) AS run FROM (SELECT *, lag(clear) OVER (PARTITION BY page ORDER BY x) AS p FROM c))
SELECT page, min(x) AS x0, max(until) AS x1 FROM r WHERE clear GROUP BY page, run HAVING max(until) - min(x) >= 5)"""


@query(f"SELECT page, x0, x1 FROM {GUTTER_SQL}")
def clear_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.clear_runs(_boxes(spark, sf_dir, NARROW), ["page"], "x0", "x1", 0, 5.0)


@query(f"""
WITH g AS (SELECT * FROM {GUTTER_SQL}), c AS (SELECT page, x1 AS x FROM g UNION ALL SELECT DISTINCT page, 0.0::DOUBLE FROM {NARROW_SQL})
SELECT c.page, c.x AS x0, coalesce((SELECT min(g.x0) FROM g WHERE g.page = c.page AND g.x0 >= c.x), 420.0::DOUBLE) AS x1 FROM c""")
def column_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = _boxes(spark, sf_dir, NARROW)
    edges = narrow.select("page").distinct().selectExpr("page", "0.0D AS lo", "420.0D AS hi")
    return boxes.spans_between(boxes.clear_runs(narrow, ["page"], "x0", "x1", 0, 5.0), ["page"], edges, 1.0)


@query(f"""
WITH b AS (SELECT page, id % 6 AS row, x0, x1, floor(x0 / 55)::BIGINT AS col FROM {BOX_SQL}), g AS (SELECT page, col * 55.0::DOUBLE + 50 AS x0, col * 55.0::DOUBLE + 55 AS x1 FROM {CELL_SQL} WHERE row = 0),
k AS (SELECT b.page, b.row, count(DISTINCT g.x0) AS crossed FROM b JOIN g ON g.page = b.page AND b.x0 < g.x0 AND b.x1 > g.x1 GROUP BY 1, 2)
SELECT b.page, b.row, count(DISTINCT col) AS columns, coalesce(max(crossed), 0) AS crossed FROM b LEFT JOIN k USING (page, row) GROUP BY 1, 2""")
def row_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).selectExpr("page", "id % 6 AS row", "x0", "x1", "floor(x0 / 55) AS col")
    gutters = _cells(spark, sf_dir).where("row = 0").selectExpr("page", "x0 + 50 AS x0", "x0 + 55 AS x1")
    return boxes.row_occupancy(words, ["page", "row"], "col", gutters, ["page"], 50.0)


@query(None)
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.suppress(_boxes(spark, sf_dir).select("page", "id", *boxes.SIDES, "confidence"), ["page"], "confidence", "id", 0.4).select("page", "id")


@query(f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 60), x0, y0) AS place FROM {BRAND_BOX_SQL}")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.reading_order(_boxes(spark, sf_dir, BRAND_BOX).withColumn("line", F.floor(F.col("y0") / 60)), ["page"], "line", ["id"]).select("page", "id", "place")


# An order, and an item that several orders may have at the same place.
EDGE = ("l_orderkey AS a", "1000000000000 + l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS b")
EDGE_SQL = f"(SELECT DISTINCT {EDGE[0]}, {EDGE[1]} FROM lineitem)"


@query(f"""
WITH RECURSIVE e AS (SELECT a, b FROM {EDGE_SQL} UNION SELECT b, a FROM {EDGE_SQL}),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT node, least(min(root), node) AS root FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").selectExpr(*EDGE).distinct()
    return graph.components(edges)


@query("""
WITH f AS (SELECT event_type, user_id, min(struct_pack(ts := ts, id := event_id)) AS f FROM events GROUP BY 1, 2)
SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY f, user_id) - 1 AS dense FROM f""")
def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dense_labels(table(spark, sf_dir, "events"), ["event_type"], "user_id", ["ts", "event_id"])


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, other) AS k FROM p)
SELECT a.id, a.other, round(a.c, 6) AS cosine FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2 WHERE round(1 - a.c, 9) <= 0.8::DOUBLE * round(1 - b.c, 9)""")
def nndr_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours by cosine within a label that are clearly nearer than the second nearest."""
    return joins.ratio_matches(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.8)
