"""Queries on profiles, peaks, bands, hosts and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.functions import groups
from tablescribe.operators import boxes, shapes
from tablescribe.plans.boxes import BOX_SQL, BRAND_BOX, BRAND_BOX_SQL, BRAND_MOVED, BRAND_MOVED_SQL, PAGE, _boxes
from tablescribe.plans.registry import pattern_sql as _sql
from tablescribe.plans.registry import query
from tablescribe.plans.rows import CELLS, FRAGMENTS, _parts
from tablescribe.sources.tables import table


@query("SELECT l_suppkey, l_linenumber AS at, sum(l_quantity) AS ink FROM lineitem WHERE l_partkey >= 500 AND l_partkey < 900 GROUP BY 1, 2")
def band_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.profile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_partkey", 500, 900, "l_quantity").withColumnRenamed("l_linenumber", "at")


@query("""
WITH c AS (SELECT p_brand, floor((p_retailprice - 900) / 20)::INT AS bin, count(*) AS n FROM part WHERE p_retailprice >= 900 AND p_retailprice < 1400 GROUP BY 1, 2), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, bin) = 1),
j AS (SELECT b.p_brand, b.bin, b.n, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM b LEFT JOIN c l ON l.p_brand = b.p_brand AND l.bin = b.bin - 1 LEFT JOIN c r ON r.p_brand = b.p_brand AND r.bin = b.bin + 1)
SELECT p_brand, bin, n, round(900 + (bin + 0.5::DOUBLE + CASE WHEN l - 2 * n + r <> 0 THEN 0.5::DOUBLE * (l - r) / (l - 2 * n + r) ELSE 0 END) * 20, 6) AS peak FROM j""")
def histogram_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.histogram_peak(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 900.0, 1400.0, 25)


@query(f"""
WITH s AS (SELECT page, y1 - y0 AS h, (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page ORDER BY (y0 + y1) / 2) AS d FROM {BOX_SQL}) SELECT page, round(median(d), 6) AS pitch, round(median(h), 6) AS height FROM s GROUP BY 1""")
def row_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.pitch(_boxes(spark, sf_dir), ["page"], "y0", "y1").select("page", F.round("pitch", 6).alias("pitch"), F.round("height", 6).alias("height"))


@query(f"""
WITH b AS (SELECT DISTINCT page, r * 70.0::DOUBLE AS b0, r * 70.0::DOUBLE + 50 AS b1 FROM {BOX_SQL}, (SELECT range AS r FROM range(6)))
SELECT b.page, b.b0, count(*) AS members, min(x.y0) AS lo, max(x.y1) AS hi FROM b JOIN {BOX_SQL} x ON x.page = b.page AND (x.y0 + x.y1) / 2 >= b0 AND (x.y0 + x.y1) / 2 < b1 GROUP BY 1, 2""")
def rows_in_ruled_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    bands = rows.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r")).selectExpr("page", "r * 70.0D AS b0", "r * 70.0D + 50 AS b1")
    return shapes.rows_in_bands(rows, bands, ["page"], "y0", "y1", 50.0)


@query(f"""
WITH p AS (SELECT a.page, a.id, b.id AS host, round((least(a.y1, b.y1) - greatest(a.y0, b.y0)) / (a.y1 - a.y0), 9) AS o FROM {BRAND_BOX_SQL} a JOIN {BRAND_MOVED_SQL} b ON a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
h AS (SELECT * FROM p WHERE o >= 0.5 QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY o DESC, host) = 1)
SELECT a.page, a.id, host FROM {BRAND_BOX_SQL} a LEFT JOIN h USING (page, id)""")
def host_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.host_rows(_boxes(spark, sf_dir, BRAND_BOX).select("page", "id", *boxes.SIDES), _boxes(spark, sf_dir, BRAND_MOVED), ["page"], "id", 0.5, 50.0)


@query(f"""
WITH p AS (SELECT DISTINCT page, id % 4 AS l, x0 AS x, y0 AS y FROM {BRAND_BOX_SQL})
SELECT a.page, a.l AS a, b.l AS b, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance FROM p a JOIN p b ON a.page = b.page AND a.l < b.l AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64 GROUP BY 1, 2, 3""")
def label_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _boxes(spark, sf_dir, BRAND_BOX).selectExpr("page", "id % 4 AS l", "x0 AS x", "y0 AS y")
    return shapes.label_distances(points, ["page"], "l", 8.0).withColumn("distance", F.round("distance", 6))


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT * FROM p WHERE cosine >= 0.15""")
def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.similar_pairs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", 0.15)


KIND = r"(?i)^[\s(]*[-+]?(?:[\d,]*\.?\d+%?|\d+[A-Z]\d{3,}|[\dA-Z]?\d+X\d+(?:X\d+)?['’]?S?)[)\s]*$"


@query(f"""
WITH p AS (SELECT p_partkey, 3 + p_size % 3 AS fill, {", ".join(f"trim(coalesce({v}, '')) AS {k}" for k, v in CELLS.items() if k != "c0")}, CAST(p_size AS VARCHAR) AS c0 FROM part),
q AS (SELECT *, [c0, c1, c2, c3] AS t FROM p), r AS (SELECT *, array_to_string(t, ' ') AS j, len(list_filter(t, lambda x: x <> '')) AS n, len(list_filter(t, lambda x: x <> '' AND regexp_matches(x, {_sql(KIND)}))) AS k FROM q)
SELECT p_partkey, CASE WHEN regexp_matches(j, {_sql(groups.TOTAL_WORD)}) AND regexp_matches(j, '\\d') THEN 'total' WHEN n >= greatest(2, 0.6 * fill) AND k >= least(3, greatest(2, floor(0.3 * fill))) THEN 'item' ELSE '' END AS kind FROM r""")
def row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **CELLS).select("p_partkey", (3 + F.col("p_size") % 3).alias("fill"), F.array(F.col("p_size").cast("string"), "c1", "c2", "c3").alias("t"))
    return rows.select("p_partkey", shapes.row_kind(F.col("t"), groups.group_name_of(F.col("t"), FRAGMENTS), F.col("fill")).alias("kind"))


@query("""
SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def cell_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return counts.select("l_suppkey", *[F.col(c).alias(c.lower()) for c in "ANR"])


@query(None)
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.convex_hull(_boxes(spark, sf_dir), ["page"], "x0", "y0")


@query(None)
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.simplified(table(spark, sf_dir, "part").selectExpr(PAGE, "p_partkey AS id", "p_retailprice AS y", "CAST(p_partkey AS DOUBLE) AS x"), ["page"], "id", "x", "y", 20.0)
