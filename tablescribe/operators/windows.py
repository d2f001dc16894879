"""Order-based operators: gaps and islands, carried values, smoothing, sequence tests, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, by: list[str], order: str, value: str, radius: int) -> DataFrame:
    """df with `smooth`: mean over the rows up to `radius` before and after, fewer at the ends."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-radius, radius)
    return df.withColumn("smooth", F.avg(value).over(w))


def islands(df: DataFrame, by: list[str], order: list[str], inside: Column, least: int) -> DataFrame:
    """Runs of consecutive rows where `inside` holds, `least` rows or longer: first and last order value, rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    marked = marked.withColumn("__run", F.sum(F.when(F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    runs = marked.where("__in").groupBy(*by, "__run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"))
    return runs.where(F.col("rows") >= least).drop("__run")


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the latest value that isn't null, the row's own included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def open_groups(df: DataFrame, by: list[str], order: list[str], opens: Column, item: Column, value: Column, name: str) -> DataFrame:
    """df with the value of the latest row that opens a group, the row's own included; a row opens one only if an item follows."""
    w = Window.partitionBy(*by).orderBy(*order)
    later = F.max(item).over(w.rowsBetween(1, Window.unboundedFollowing))
    return carry_forward(df.withColumn("__later", later), by, order, F.when(opens & F.coalesce("__later", F.lit(False)), value), name).drop("__later")


def sequential_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the values that follow the one before by one; null for groups of one."""
    w = Window.partitionBy(*by).orderBy(value)
    steps = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    return steps.groupBy(*by).agg(F.avg(F.when(F.col("__d").isNotNull(), (F.col("__d") == 1).cast("double"))).alias("share"), F.count("*").alias("rows"))


def collapse(df: DataFrame, by: list[str], order: list[str], token: str, blank: str) -> DataFrame:
    """Rows whose token differs from the one before and isn't the blank (greedy decoding of a token sequence)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__p", F.lag(token).over(w)).where((F.col(token) != blank) & ~F.col(token).eqNullSafe(F.col("__p"))).drop("__p")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order, with `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key, null keys equal: by a minimum, so that frequent keys are summed up before the shuffle."""
    keyed = df.select(F.struct(*key).alias("__k"), F.struct(*order, *[c for c in df.columns if c not in order]).alias("__r"))
    return keyed.groupBy("__k").agg(F.min("__r").alias("__r"), F.count("*").alias("copies")).select("__r.*", "copies")
