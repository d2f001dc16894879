"""Printed rules as a graph: crossings of horizontal and vertical rules, the grids they make, and where a grid falls into sections.

Crossings are a join on square buckets, grids are connected components over them; both take any number of pages. A grid's own
rules, some tens, are then read in one go for its sections, rows and columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescribe.operators.boxes import overlap_candidates
from tablescribe.operators.graph import components
from tablescribe.operators.joins import meeting_square, sorted_side, square_level


def crossings(rules: DataFrame, by: Sequence[str], tolerance: float, width: float) -> DataFrame:
    """(by, h, v, x, y): each horizontal rule with each vertical one that meets it, tolerance included.

    rules: by, id (unique), flat (horizontal or not), x0, y0, x1, y1; a horizontal rule lies at y0, a vertical one at x0. Rules with a
    null or reversed side cross nothing. width: a usual length.
    """
    sides = ("x0", "y0", "x1", "y1")
    flat = rules.where("flat").select(*by, "id", (F.col("x0") - tolerance).alias("x0"), F.col("y0"), (F.col("x1") + tolerance).alias("x1"), F.col("y0").alias("y1"), (F.col("x0") <= F.col("x1")).alias("ok"))
    steep = rules.where("not flat").select(*by, "id", F.col("x0"), (F.col("y0") - tolerance).alias("y0"), F.col("x0").alias("x1"), (F.col("y1") + tolerance).alias("y1"), (F.col("y0") <= F.col("y1")).alias("ok"))
    pairs = overlap_candidates(flat.where("ok").drop("ok"), steep.where("ok").drop("ok"), by, width)
    meet = (F.col("b_x0") >= F.col("a_x0")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") >= F.col("b_y0")) & (F.col("a_y0") <= F.col("b_y1"))
    a, b = ([F.col(f"{k}_{s}") for s in sides] for k in "ab")
    once = meeting_square(a, b, square_level(a, width), square_level(b, width), F.col("__b"))
    return pairs.where(meet & once).select(*by, F.col("a_id").alias("h"), F.col("b_id").alias("v"), F.col("b_x0").alias("x"), F.col("a_y0").alias("y"))


def grids(rules: DataFrame, crossed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, grid, flats, steeps, crossings, x0, y0, x1, y1, nth): connected rules, two of each kind at least, as grids; grid is the smallest
    id in it, nth its place on the page by crossings, then area, then id."""
    of = components(crossed.select(F.col("h").alias("a"), F.col("v").alias("b"))).withColumnsRenamed({"node": "id", "root": "grid"})
    inside = rules.join(sorted_side(of), "id")
    box = inside.groupBy(*by, "grid").agg(
        F.count_if("flat").alias("flats"), F.count_if(~F.col("flat")).alias("steeps"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(F.when(F.col("flat"), F.col("x1")).otherwise(F.col("x0"))).alias("x1"), F.max(F.when(F.col("flat"), F.col("y0")).otherwise(F.col("y1"))).alias("y1")
    )
    count = crossed.join(sorted_side(of.withColumnRenamed("id", "h")), "h").groupBy("grid").agg(F.count("*").alias("crossings"))
    found = box.where("flats >= 2 and steeps >= 2").join(sorted_side(count), "grid")
    order = Window.partitionBy(*by).orderBy(F.desc("crossings"), F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "grid")
    return found.select(*by, "grid", "flats", "steeps", "crossings", "x0", "y0", "x1", "y1", F.row_number().over(order).alias("nth"))


def merged(rules: Sequence[tuple], tolerance: float) -> list[tuple]:
    """Rules (at, from, to) from the lowest place on; of two within the tolerance the longer stays."""
    out: list[tuple] = []
    for r in sorted(rules):
        if out and r[0] - out[-1][0] <= tolerance:
            if r[2] - r[1] > out[-1][2] - out[-1][1]:
                out[-1] = r
        else:
            out.append(r)
    return out


def sections(flats: Sequence[tuple], steeps: Sequence[tuple], x0: float, x1: float, tolerance: float) -> list[tuple[int, int, int]]:
    """The sections of a grid as (first rule, last rule, crossings) over its merged flat rules (y, x0, x1) from the top.

    Between two neighbouring rules lies a band with the separators that span it, the outer frame left out. A rule over 70 % of the width
    divides two sections if the bands above and below have two separators each and share a quarter of them at most: separators
    are shared if one rule spans both bands, or if they stand within a third of the tolerance (3 at least).
    """
    inner = [(k, x, a, b) for k, (x, a, b) in enumerate(steeps) if x0 + 2 * tolerance < x < x1 - 2 * tolerance]
    bands = [[(k, x) for k, x, a, b in inner if a <= top[0] + tolerance and b >= low[0] - tolerance] for top, low in zip(flats, flats[1:])]
    tight = max(3.0, tolerance / 3)
    starts = [0]
    for i in range(1, len(flats) - 1):
        above, below = bands[i - 1], bands[i]
        shared = sum(any(k == m or abs(x - z) <= tight for m, z in below) for k, x in above)
        wide = flats[i][2] - flats[i][1] + 1 >= 0.7 * (x1 - x0)
        if wide and min(len(above), len(below)) >= 2 and shared <= 0.25 * min(len(above), len(below)):
            starts.append(i)
    ends = [*starts[1:], len(flats) - 1]
    return [(a, b, sum(map(len, bands[a:b]))) for a, b in zip(starts, ends)]


def grid_layout(flats: Sequence[tuple], steeps: Sequence[tuple], box: tuple[float, float, float, float], page_height: float, tolerance: float) -> dict:
    """What a grid is: kind, its top and bottom, the rules that divide sections, rows and columns.

    The section with the most crossings (then the most bands, then the first) is the table. A grid of 12 % of the page's height is a
    boxed header whatever its rules; with three flat rules it is a full grid, else a vertical one.
    """
    x0, y0, x1, y1 = box
    rows, columns = merged(flats, tolerance), merged(steeps, tolerance)
    parts = sections(rows, columns, x0, x1, tolerance) if len(rows) >= 3 and len(columns) >= 3 else []
    splits = [rows[a][0] for a, *_ in parts[1:]]
    if splits:
        first, last, _ = max(parts, key=lambda p: (p[2], p[1] - p[0], -p[0]))
        y0, y1 = rows[first][0], rows[last][0]
        rows = [r for r in rows if y0 - tolerance <= r[0] <= y1 + tolerance]
        columns = [c for c in columns if c[1] <= y1 - tolerance and c[2] >= y0 + tolerance]
    kind = "header-box" if y1 - y0 <= 0.12 * page_height else "full-grid" if len(rows) >= 3 else "vertical-grid"
    return {"kind": kind, "top": y0, "bottom": y1, "splits": splits, "rows": [r[0] for r in rows], "columns": [c[0] for c in columns]}


_NUMBERS = T.ArrayType(T.DoubleType())
_LAYOUT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField("bottom", T.DoubleType()), T.StructField("splits", _NUMBERS), T.StructField("rows", _NUMBERS), T.StructField("columns", _NUMBERS)])


def layouts(rules: DataFrame, crossed: DataFrame, by: Sequence[str], page_height: float, tolerance: float) -> DataFrame:
    """The first grid of each page with what it is: by, grid, kind, top, bottom, splits, rows, columns."""

    @F.pandas_udf(_LAYOUT)
    def of(flats: pd.Series, steeps: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        plain = lambda rules: [(r["at"], r["lo"], r["hi"]) for r in rules]
        return pd.DataFrame([grid_layout(plain(a), plain(b), tuple(box), page_height, tolerance) for a, b, *box in zip(flats, steeps, x0, y0, x1, y1)], columns=_LAYOUT.names)

    best = grids(rules, crossed, by).where("nth = 1")
    of_rule = components(crossed.select(F.col("h").alias("a"), F.col("v").alias("b"))).withColumnsRenamed({"node": "id", "root": "grid"})
    number = lambda c: F.col(c).cast("double")
    flat = F.struct(number("y0").alias("at"), number("x0").alias("lo"), number("x1").alias("hi"))
    steep = F.struct(number("x0").alias("at"), number("y0").alias("lo"), number("y1").alias("hi"))
    own = rules.join(sorted_side(of_rule), "id").groupBy("grid").agg(F.collect_list(F.when(F.col("flat"), flat)).alias("flats"), F.collect_list(F.when(~F.col("flat"), steep)).alias("steeps"))
    laid = best.drop("flats", "steeps").join(sorted_side(own), "grid").withColumn("l", of("flats", "steeps", number("x0"), number("y0"), number("x1"), number("y1")))
    return laid.select(*by, "grid", "l.*")
