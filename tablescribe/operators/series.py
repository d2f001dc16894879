"""Operators on ordered rows: grouping by gaps, greedy lines, slopes, runs with a gap, drops, decoding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.operators.aggregates import upper_median


def by_gap(df: DataFrame, by: Sequence[str], lo: str, hi: str, gap: float) -> DataFrame:
    """df with `part`, 1, 2, ...: a new one begins where a span starts more than `gap` after the furthest end so far."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("__new", F.coalesce((F.col(lo) - reach > gap), F.lit(True)).cast("int"))
    return new.withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_clusters(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], reach: float) -> DataFrame:
    """df with `cluster`, 0, 1, ...: in ascending order a value joins the last cluster if it lies within `reach` of the
    running mean of its members. Each step needs the one before, so a group (a page's rows) is one task's work."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, *order], kind="stable")
        out, cluster, total, n = [], -1, 0.0, 0
        for x in pdf[value]:
            if n and abs(x - total / n) <= reach:
                total, n = total + x, n + 1
            else:
                cluster, total, n = cluster + 1, float(x), 1
            out.append(cluster)
        return pdf.assign(cluster=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cluster int"
    return df.where(F.col(value).isNotNull()).groupBy(*by).applyInPandas(walk, schema)


def running_cluster_bounds(df: DataFrame, by: Sequence[str], value: str, reach: float) -> DataFrame:
    """(by, cluster, members, lo, hi): the clusters of running_clusters by number. Equal values are counted first and follow each other
    into one cluster, so a group's task walks along its distinct values only; values that aren't numbers are clusters of their own."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value, kind="stable")
        out, total, n = [], 0.0, 0
        for x, times in zip(pdf[value].to_numpy(float), pdf["__n"]):
            if x != x:
                out += [[len(out) + i, 1, x, x] for i in range(times)]
                continue
            if not (n and abs(x - total / n) <= reach):
                total, n = 0.0, 0
                out.append([len(out), 0, x, x])
            for first in range(0, times, 1 << 16):  # one by one: a product would be rounded in another way
                total = float(np.add.accumulate(np.concatenate([[total], np.full(min(times - first, 1 << 16), x)]))[-1])
            n += times
            out[-1][1:] = [n, out[-1][2], x]
        ends = pd.DataFrame(out, columns=["cluster", "members", "lo", "hi"])
        return ends.assign(**{c: [pdf[c].iloc[0]] * len(ends) for c in by})[[*by, "cluster", "members", "lo", "hi"]]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "cluster int, members long", f"lo {types[value]}, hi {types[value]}"])
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).applyInPandas(walk, schema)


def lines_by_overlap(df: DataFrame, by: Sequence[str], lo: str, hi: str, id_col: str, share: float, back: int = 6) -> DataFrame:
    """df with `line`, 0, 1, ...: in ascending order a span joins the best of the last `back` lines that it overlaps by
    `share` of the shorter, and widens it; else it begins a line. A group (a page) is one task's work."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([lo, hi, id_col], kind="stable")
        lines, out = [], []
        for a, b in zip(pdf[lo], pdf[hi]):
            best = None
            for i in range(len(lines) - 1, max(-1, len(lines) - 1 - back), -1):
                x, y = lines[i]
                over = min(b, y) - max(a, x)
                if over >= share * min(b - a, y - x) and (best is None or over > best[0]):
                    best = (over, i)
            if best is None:
                lines.append((a, b))
                out.append(len(lines) - 1)
            else:
                lines[best[1]] = (min(a, lines[best[1]][0]), max(b, lines[best[1]][1]))
                out.append(best[1])
        return pdf.assign(line=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", line int"
    return df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).groupBy(*by).applyInPandas(walk, schema)


def widest_gap(df: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    """(by, start, gap): the widest stretch between a group's first and last span that none covers; of equals the first."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = df.select(*by, reach.alias("start"), (F.col(lo) - reach).alias("gap")).where("gap > 0")
    best = F.max(F.struct("gap", (-F.col("start")).alias("s")))
    return gaps.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.s")).alias("start"), "b.gap")


def theil_sen(points: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, slope, offset): the upper median (element n // 2) of the slopes between all points of a group with different x, and of
    what it leaves of y. Pairs are made by a join and grow with the square of a group, which is one line's points; no group is
    collected. Groups with one x only, and points with a null, have no slope."""
    w = Window.partitionBy(*by).orderBy(x, y)
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = (rows.select(*by, F.col(x).alias(f"__x{k}"), F.col(y).alias(f"__y{k}"), F.row_number().over(w).alias(f"__n{k}")) for k in "ab")
    slopes = a.join(b, list(by)).where("__nb > __na and __xb > __xa").select(*by, ((F.col("__ya") - F.col("__yb")) / (F.col("__xa") - F.col("__xb"))).alias("slope"))
    slope = upper_median(slopes, list(by), "slope").withColumnRenamed("upper_median", "slope")
    left = rows.join(slope, list(by)).select(*by, "slope", (F.col(y) - F.col("slope") * F.col(x)).alias("offset"))
    return slope.join(upper_median(left, list(by), "offset").withColumnRenamed("upper_median", "offset"), list(by))


def longest_run(df: DataFrame, by: Sequence[str], order: str, inside: Column, misses: int = 1) -> DataFrame:
    """(by, first, last, rows): the longest run of rows inside that tolerates `misses` rows outside in a row; of equals the
    first. `rows` counts the rows inside."""
    w = Window.partitionBy(*by).orderBy(order)
    placed = df.withColumn("__n", F.row_number().over(w)).where(F.coalesce(inside, F.lit(False)))
    v = Window.partitionBy(*by).orderBy("__n")
    new = F.coalesce((F.col("__n") - F.lag("__n").over(v)) > misses + 1, F.lit(True)).cast("int")
    runs = placed.withColumn("__new", new).withColumn("__r", F.sum("__new").over(v)).groupBy(*by, "__r").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))
    best = F.min(F.struct((-F.col("rows")).alias("n"), "first", "last"))
    return runs.groupBy(*by).agg(best.alias("b")).select(*by, "b.first", "b.last", (-F.col("b.n")).alias("rows"))


def first_block(df: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """(by, start, end): of the blocks of consecutive whole numbers the longest, of equals the first."""
    rows = df.select(*by, at).distinct()
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    blocks = rows.withColumn("__i", island).groupBy(*by, "__i").agg(F.min(at).alias("start"), F.max(at).alias("end"))
    best = F.min(F.struct((F.col("start") - F.col("end")).alias("n"), "start", "end"))
    return blocks.groupBy(*by).agg(best.alias("b")).select(*by, "b.start", "b.end")


def first_after(df: DataFrame, by: Sequence[str], order: str, item: Column, close: Column) -> DataFrame:
    """(by, at): the first row that closes a group after an item; rows that close are no items."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    closes = F.coalesce(close, F.lit(False))
    marked = df.withColumn("__c", closes).withColumn("__seen", F.max(F.coalesce(item, F.lit(False)) & ~closes).over(w))
    return marked.where("__c and __seen").groupBy(*by).agg(F.min(order).alias("at"))


def worst_drop(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, at, drop): where the value falls most from one row to the next; of equals the first; groups without a fall drop out."""
    step = F.lag(value).over(Window.partitionBy(*by).orderBy(order)) - F.col(value)
    steps = df.select(*by, order, step.alias("drop")).where("drop > 0")
    best = F.min(F.struct((-F.col("drop")).alias("d"), order))
    return steps.groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{order}").alias("at"), (-F.col("b.d")).alias("drop"))


def half_window_mean(df: DataFrame, by: Sequence[str], order: str, value: str, window: int) -> DataFrame:
    """df with `smooth`: mean over window // 2 rows before and after, divided by the rows there are."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(window // 2), window // 2)
    return df.withColumn("smooth", F.sum(value).over(w) / F.count(value).over(w))


def collapse_close(df: DataFrame, by: Sequence[str], at: str, least: float) -> DataFrame:
    """(by, at): boundaries of which one closer than `least` to the last kept one is merged into it as their mean, from the
    left. A group (a page's boundaries) is one task's work."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        for x in np.sort(pdf[at].to_numpy(float)):
            if kept and x - kept[-1] < least:
                kept[-1] = (kept[-1] + x) / 2
            else:
                kept.append(x)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(kept) for c in by}, at: kept})

    schema = ", ".join([*[f"`{c}` {dict(df.dtypes)[c]}" for c in by], f"`{at}` double"])
    return df.where(F.col(at).isNotNull()).select(*by, at).groupBy(*by).applyInPandas(walk, schema)


def softmax(values: Column) -> Column:
    """Shares of exp(value), which add up to 1; an empty array stays empty."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda p: p / total)


def decode(steps: DataFrame, by: Sequence[str], order: str, scores: str, blank: int) -> DataFrame:
    """(by, tokens, confidence): the best class of every step, repeats and the blank taken out, and the mean share of the
    steps kept; null where none is."""
    w = Window.partitionBy(*by).orderBy(order)
    shares = softmax(F.col(scores))
    best = steps.withColumn("__s", shares).withColumn("__p", F.array_max("__s")).withColumn("__t", (F.array_position("__s", F.col("__p")) - 1).cast("int"))
    kept = best.withColumn("__l", F.lag("__t").over(w)).withColumn("__k", (F.col("__t") != blank) & ~F.col("__t").eqNullSafe(F.col("__l")))
    chosen = F.collect_list(F.when(F.col("__k"), F.struct(F.col(order).alias("o"), F.col("__t").cast("string").alias("t"))))
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(chosen), lambda c: c["t"]), " ").alias("tokens"), F.avg(F.when(F.col("__k"), F.col("__p"))).alias("confidence"))
