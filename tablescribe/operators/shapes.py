"""Profiles, peaks, pitches, bands, hosts and outlines of rows and points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.functions import groups
from tablescribe.operators.boxes import SIDES, equal_boxes, overlapping
from tablescribe.operators.joins import point_keys, range_keys, sorted_side
from tablescribe.operators.vectors import alike


def profile(points: DataFrame, by: Sequence[str], at: str, across: str, lo: float, hi: float, ink: str) -> DataFrame:
    """(by, at, ink): the ink along one axis within a half-open band of the other."""
    return points.where((F.col(across) >= lo) & (F.col(across) < hi)).groupBy(*by, at).agg(F.sum(ink).alias("ink"))


def histogram_peak(values: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n, peak): the fullest of `bins` equal bins (of equals the first), and the top of the parabola through it and its
    neighbours, as a value; bins at the ends have none on one side."""
    width = (hi - lo) / bins
    inside = values.where((F.col(value) >= lo) & (F.col(value) < hi))
    counts = inside.groupBy(*by, F.floor((F.col(value) - lo) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "bin")).alias("b"))
    joined = counts.join(best, list(by)).groupBy(*by, "b").agg(*[F.coalesce(F.max(F.when(F.col("bin") == F.col("b.bin") + d, F.col("n"))), F.lit(0)).alias(c) for d, c in ((-1, "l"), (0, "m"), (1, "r"))])
    bend = F.col("l") - 2 * F.col("m") + F.col("r")
    shift = F.when(bend != 0, 0.5 * (F.col("l") - F.col("r")) / bend).otherwise(0.0)
    return joined.select(*by, F.col("b.bin").alias("bin"), F.col("m").alias("n"), F.round(lo + (F.col("b.bin") + 0.5 + shift) * width, 6).alias("peak"))


def pitch(rows: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    """(by, pitch, height): median distance of consecutive row centres and median height."""
    centre = (F.col(lo) + F.col(hi)) / 2
    steps = rows.select(*by, (F.col(hi) - F.col(lo)).alias("h"), (centre - F.lag(centre).over(Window.partitionBy(*by).orderBy(centre))).alias("d"))
    return steps.groupBy(*by).agg(F.median("d").alias("pitch"), F.median("h").alias("height"))


def rows_in_bands(rows: DataFrame, bands: DataFrame, by: Sequence[str], lo: str, hi: str, width: float) -> DataFrame:
    """(by, b0, members, lo, hi): the rows whose centres lie between two rules (by, b0, b1), folded into one row a band."""
    centred = rows.select(*by, lo, hi, ((F.col(lo) + F.col(hi)) / 2).alias("__c")).withColumn("__k", F.explode(point_keys(F.col("__c"), width)))
    banded = bands.select(*by, "b0", "b1").withColumn("__k", F.explode(range_keys(F.col("b0"), F.col("b1"), width)))
    inside = centred.join(banded, [*by, "__k"]).where("__c >= b0 and __c < b1")
    return inside.groupBy(*by, "b0").agg(F.count("*").alias("members"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def host_rows(rows: DataFrame, hosts: DataFrame, by: Sequence[str], id_col: str, share: float, width: float) -> DataFrame:
    """(by, id, host): the box that covers most of a box's height, `share` of it at least; of equals the smaller id; null if none.
    Equal boxes meet once."""
    over = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    pairs = overlapping(equal_boxes(rows, by), equal_boxes(hosts, by, F.min(id_col).alias("host")), by, width).withColumn("__o", over / (F.col("a_y1") - F.col("a_y0"))).where(F.col("__o") >= share)
    each = pairs.groupBy(*by, *[F.col(f"a_{s}").alias(s) for s in SIDES], (-F.round("__o", 9)).alias("o")).agg(F.min("b_host").alias("h"))  # a hash table of numbers, then few rows
    best = each.groupBy(*by, *SIDES).agg(F.min(F.struct("o", "h")).alias("b"))
    return rows.select(*by, id_col, *SIDES).join(sorted_side(best), [*by, *SIDES], "left").select(*by, id_col, F.col("b.h").alias("host"))


def label_distances(points: DataFrame, by: Sequence[str], label: str, radius: float) -> DataFrame:
    """(by, a, b, distance): the least distance of points (x, y) of two labels within the radius of each other."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select(*by, F.col(label).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = points.select(*by, F.col(label).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("x0"), cell("y").alias("y0")).distinct()
    q = q.withColumn("s", F.explode(shifts)).withColumns({"cx": F.col("x0") + F.col("s.i"), "cy": F.col("y0") + F.col("s.j")}).drop("s", "x0", "y0")
    apart = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return q.join(p, [*by, "cx", "cy"]).where((F.col("a") < F.col("b")) & (apart <= radius * radius)).groupBy(*by, "a", "b").agg(F.sqrt(F.min(apart)).alias("distance"))


def similar_pairs(vectors: DataFrame, by: Sequence[str], id_col: str, vector: str, least: float) -> DataFrame:
    """(a, b, cosine): pairs of a group with a cosine of `least` or more, rounded to 6 digits; groups bound the pairs compared."""
    pairs = alike(vectors, by, id_col, vector, least - 1e-6)
    return pairs.select("a", "b", F.round("c", 6).alias("cosine")).where(F.col("cosine") >= least)


def row_kind(texts: Column, name: Column, item_fill: Column) -> Column:
    """group, total, item or '' of a row of cells: its group name (null if none) first, then a total word with a digit, then as full
    as an item row and made of numbers."""
    joined = F.array_join(F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit("")))), " ")
    full = F.size(F.filter(texts, groups.filled))
    number = r"(?i)^[\s(]*[-+]?(?:[\d,]*\.?\d+%?|\d+[A-Z]\d{3,}|[\dA-Z]?\d+X\d+(?:X\d+)?['’]?S?)[)\s]*$"
    numbers = F.size(F.filter(texts, lambda t: groups.filled(t) & F.trim(t).rlike(number)))
    enough = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(0.3 * item_fill)))
    return F.when(name.isNotNull(), "group").when(joined.rlike(groups.TOTAL_WORD) & joined.rlike(r"\d"), "total").when((full >= F.greatest(F.lit(2.0), 0.6 * item_fill)) & (numbers >= enough), "item").otherwise("")


def convex_hull(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, place, x, y): the corners of the hull, counter-clockwise from the leftmost lowest. A group is one task's work."""

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        points = sorted(set(zip(pdf[x].astype(float), pdf[y].astype(float))))

        def half(ordered: list[tuple[float, float]]) -> list[tuple[float, float]]:
            out: list[tuple[float, float]] = []
            for p in ordered:
                while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1]

        corners = half(points) + half(points[::-1]) if len(points) > 1 else points
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(corners) for c in by}, "place": range(len(corners)), "x": [p[0] for p in corners], "y": [p[1] for p in corners]})

    schema = ", ".join([*[f"`{c}` {dict(points.dtypes)[c]}" for c in by], "place int, x double, y double"])
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).applyInPandas(hull, schema)


def simplified(points: DataFrame, by: Sequence[str], order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """The points of a line that keep every other one within the tolerance of the chords between them. A group is one task's work."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p, keep, todo = pdf[[x, y]].to_numpy(float), {0, len(pdf) - 1}, [(0, len(pdf) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, rest = p[b] - p[a], p[a + 1 : b] - p[a]
            far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / max(np.hypot(*d), 1e-12) if np.hypot(*d) > 0 else np.hypot(rest[:, 0], rest[:, 1])
            k = int(far.argmax())
            if far[k] > tolerance:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf.iloc[sorted(keep)]

    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).applyInPandas(cut, points.schema)
