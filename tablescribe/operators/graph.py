"""Graphs as edge tables: components, dense labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.operators.joins import sorted_side
from tablescribe.sources.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the smallest node reachable.

    Large-star and small-star rounds: every round is two group minima and two joins, so a node of any
    degree is only ever aggregated, never collected, and the number of edges doesn't grow. Rounds end
    when the edge set no longer changes. Edges with a null end and loops are left out. keep writes a round's edges.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = keep(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sorted_side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        now = keep(large.join(sorted_side(least), "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dense_labels(df: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """(by, label, dense): labels numbered from 0 in the order in which they first appear; within `by`, never over the whole table."""
    first = df.groupBy(*by, label).agg(F.min(F.struct(*order)).alias("__f"))
    return first.select(*by, label, (F.row_number().over(Window.partitionBy(*by).orderBy("__f", label)) - 1).alias("dense"))


def neighbour_edges(points: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, a, b, shared): pairs of labels whose points (x, y) touch to the right or below, and how often."""
    here = points.select(*by, "x", "y", F.col(label).alias("__l"))
    steps = F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y")))
    asked = here.select(*by, F.col("__l").alias("__o"), F.explode(steps).alias("s")).select(*by, "__o", "s.x", "s.y")
    pairs = asked.join(here, [*by, "x", "y"]).where("__l != __o")
    return pairs.groupBy(*by, F.least("__l", "__o").alias("a"), F.greatest("__l", "__o").alias("b")).agg(F.count("*").alias("shared"))


def heaviest_merges(nodes: DataFrame, edges: DataFrame, least: float, rounds: int = 100, keep: Callable[[DataFrame, str], DataFrame] = written) -> tuple[DataFrame, DataFrame]:
    """Regions (id, area, cx, cy, x0, y0, x1, y1) merged along edges (a, b, score) as if the highest edge of `least` or more were merged
    again and again; returns the merged regions and (node, root) of all.

    In each round every edge that is the best of both its ends merges them: the highest of all is one of these, and merges of other
    pairs don't touch it, so the result is that of one merge at a time. Ties go to the smaller pair of ids. The smaller id stays; areas add
    up, boxes are united, centres are the rounded means of the two. Of edges between the same two the higher stays. A round is two
    joins and two aggregations; chains of rising scores take a round for each link, `rounds` at most, after which the rest stays.
    """
    now = keep(nodes.select("id", "area", "cx", "cy", "x0", "y0", "x1", "y1"), "regions")
    left = keep(edges.where((F.col("a") != F.col("b")) & (F.col("score") >= least)).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score")), "left")
    roots = keep(nodes.select(F.col("id").alias("node"), F.col("id").alias("root")), "roots")
    for _ in range(rounds):
        ends = left.select(F.explode(F.array("a", "b")).alias("end"), F.struct((-F.col("score")).alias("s"), "a", "b").alias("e"))
        best = ends.groupBy("end").agg(F.min("e").alias("e"))
        merges = keep(best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.a", "e.b"), "merges")
        if merges.isEmpty():
            break
        into = lambda df, c: df.join(merges.select(F.col("a").alias("to"), F.col("b").alias("from")), F.col(c) == F.col("from"), "left").withColumn(c, F.coalesce("to", c)).drop("to", "from")
        own = now.join(merges.select(F.col("b").alias("id"), F.col("a").alias("to")), "id", "left").withColumn("id", F.coalesce("to", "id"))
        middle = lambda c: F.floor(F.avg(c) + 0.5).cast("double").alias(c)
        now = keep(own.groupBy("id").agg(F.sum("area").alias("area"), middle("cx"), middle("cy"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")), "regions")
        moved = into(into(left, "a"), "b").where("a != b")
        left = keep(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score")), "left")
        roots = keep(into(roots, "root"), "roots")
    return now, roots
