"""Queries on a page's rows in order; a page is a brand's parts in 2,000 keys, a row is a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescribe.operators import rowstates
from tablescribe.plans.boxes import PAGE
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

# The same expressions in both dialects. A row's columns are those of 0 .. 5 that a bit of its size says; titles are near the middle.
ROW = {
    "tabular": "p_size % 6 <> 5", "has_first": "p_partkey % 4 <> 1", "filled": "p_size % 7", "keyword": "p_partkey % 11 = 3", "pieces": "p_size % 9", "title": "p_size % 10 = 7 OR p_size % 10 = 8",
    "kind": "CASE (p_partkey + p_size) % 5 WHEN 0 THEN 'item' WHEN 1 THEN 'total' WHEN 2 THEN 'group' ELSE '' END", "cells": "p_size % 8", "prose": "p_size % 8 - p_partkey % 2", "numeric": "p_partkey % 3", "titles": "p_size % 3",
}
ROWS_SQL = f"p AS (SELECT {PAGE}, p_partkey, p_size, {', '.join(f'{v} AS {k}' for k, v in ROW.items())} FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY p_partkey) - 1 AS row FROM p)"
COLUMNS_SQL = "(SELECT *, list_filter([CASE WHEN p_size % 3 > 0 THEN 0 END, CASE WHEN p_size % 4 = 0 THEN 1 END, CASE WHEN p_size % 5 = 0 THEN 2 END, CASE WHEN p_partkey % 7 = 0 THEN 3 END], lambda c: c IS NOT NULL) AS columns FROM r)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(PAGE, "p_partkey", "p_size", *[f"{v} AS {k}" for k, v in ROW.items()])
    columns = F.expr("array_compact(array(CASE WHEN p_size % 3 > 0 THEN 0 END, CASE WHEN p_size % 4 = 0 THEN 1 END, CASE WHEN p_size % 5 = 0 THEN 2 END, CASE WHEN p_partkey % 7 = 0 THEN 3 END))")
    return parts.withColumns({"row": F.row_number().over(Window.partitionBy("page").orderBy("p_partkey")) - 1, "columns": columns})


@query(f"""
WITH {ROWS_SQL}, i AS (SELECT page, row, row - row_number() OVER (PARTITION BY page ORDER BY row) AS g FROM r WHERE title),
b AS (SELECT page, min(row) AS "start", max(row) AS "end" FROM i GROUP BY page, g QUALIFY row_number() OVER (PARTITION BY page ORDER BY max(row) - min(row) DESC, min(row)) = 1),
a AS (SELECT r.*, b."start", kind = '' AND lead(kind = '', 1, false) OVER (PARTITION BY r.page ORDER BY row) AS stop FROM r JOIN b USING (page) WHERE row < b."start"),
s AS (SELECT page, max(row) FILTER (stop) AS stop FROM a GROUP BY 1), f AS (SELECT a.page, min(row) AS first FROM a JOIN s USING (page) WHERE kind <> '' AND (s.stop IS NULL OR row > s.stop) GROUP BY 1)
SELECT page, coalesce(first, "start", top) AS keep_from, coalesce("end", -1) AS title_end, coalesce("start" - coalesce(first, "start"), 0) AS above FROM (SELECT page, min(row) AS top FROM r GROUP BY 1) LEFT JOIN b USING (page) LEFT JOIN f USING (page)""")
def table_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowstates.table_tops(_rows(spark, sf_dir), ["page"])


@query(f"""
WITH {ROWS_SQL}, m AS (SELECT page, median(filled) AS fill FROM r WHERE tabular AND has_first GROUP BY 1),
t AS (SELECT *, coalesce(sum(CASE WHEN has_first AND NOT keyword THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, lead(row) OVER w - row AS step,
 coalesce(lead(has_first, 1) OVER w, false) AND coalesce(lead(has_first, 2) OVER w, false) AND coalesce(lead(has_first, 3) OVER w, false) AS three FROM r WHERE tabular WINDOW w AS (PARTITION BY page ORDER BY row)),
c AS (SELECT page, row, keyword FROM t JOIN m USING (page) WHERE NOT (has_first AND NOT keyword) AND seen >= 3 AND (keyword OR filled < 0.7 * fill) AND NOT (coalesce(step <= 2, false) AND three) QUALIFY row_number() OVER (PARTITION BY page ORDER BY row) = 1)
SELECT page, coalesce(c.row - 1, e.last) AS last, CASE WHEN keyword THEN 'keywords' WHEN c.row IS NOT NULL THEN 'structure' END AS reason FROM (SELECT page, max(row) AS last FROM r GROUP BY 1) e LEFT JOIN c USING (page)""")
def footer_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowstates.footer_cuts(_rows(spark, sf_dir), ["page"])


@query(f"""
WITH {ROWS_SQL}, f AS (SELECT *, tabular AND pieces < 0.5 * median(pieces) FILTER (tabular) OVER (PARTITION BY page) AS foreign_row FROM r),
g AS (SELECT *, sum(CASE WHEN foreign_row THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY row) AS part FROM f),
b AS (SELECT page, min(row) AS first, max(row) AS last FROM g WHERE tabular AND NOT foreign_row GROUP BY page, part QUALIFY row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, min(row)) = 1)
SELECT page, coalesce(first, top) AS first, coalesce(last, bottom) AS last FROM (SELECT page, min(row) AS top, max(row) AS bottom FROM r GROUP BY 1) LEFT JOIN b USING (page)""")
def largest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowstates.largest_blocks(_rows(spark, sf_dir), ["page"])


@query(f"""
WITH {ROWS_SQL}, c AS (SELECT page, row, len(columns) = 1 AND list_contains(columns, 0) AS described, len(columns) >= 2 AS full_row FROM {COLUMNS_SQL}),
h AS (SELECT *, last_value(CASE WHEN NOT described THEN full_row END IGNORE NULLS) OVER (PARTITION BY page ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM c)
SELECT page, row, sum(CASE WHEN described AND coalesce(head, false) THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY row)::BIGINT AS logical FROM h""")
def logical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowstates.logical_rows(_rows(spark, sf_dir), ["page"]).select("page", "row", "logical")


@query(f"WITH {ROWS_SQL} SELECT page, CASE WHEN len(columns) >= 2 THEN row ELSE 0 END AS header FROM {COLUMNS_SQL} WHERE row < 3 QUALIFY row_number() OVER (PARTITION BY page ORDER BY len(columns) DESC, row) = 1")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowstates.header_rows(_rows(spark, sf_dir), ["page"])


@query(f"""
WITH {ROWS_SQL}, a AS (SELECT *, sum(cells) OVER w AS under, sum("numeric") OVER w AS numbers FROM r WINDOW w AS (PARTITION BY page ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
SELECT page, min(row) FILTER (row < 3 AND cells >= 2 AND prose >= 0.6 * cells AND (coalesce(under > 0 AND numbers >= 0.3 * under, false) OR titles >= 2)) AS header FROM a GROUP BY 1""".replace("AS numeric", 'AS "numeric"'))
def prose_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowstates.prose_headers(_rows(spark, sf_dir), ["page"])
