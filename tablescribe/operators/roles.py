"""Roles of columns: which columns are quantity, price and amount, and line items by role."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns_of(listed: str) -> list[str]:
    """The columns of a select list of plain expressions, split at the commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[start:i])
            start = i + 1
    return [*out, listed[start:]]


def product_triples(rows: DataFrame, by: Sequence[str], values: str, n: int, tolerance: float = 0.02) -> DataFrame:
    """(by, qty, price, amount, ratio, usable): of the n numeric columns (the array `values`) of each table those three for which
    amount = qty * price on most rows, the amount to the right of both; of equals the rightmost amount.

    Where the price column holds more whole numbers by a quarter of the rows, the two factors change places. One
    aggregation with two counts for each triple: the rows aren't multiplied.
    """
    v = lambda c: F.get(values, F.lit(c))
    triples = [(q, p, a) for q, p, a in permutations(range(n), 3) if a > q and a > p]
    tested = lambda q, p, a: (v(q) * v(p) * v(a)).isNotNull()
    hit = lambda q, p, a: F.abs(v(q) * v(p) - v(a)) <= tolerance * F.greatest(F.abs(v(a)), F.abs(v(q) * v(p)), F.lit(1e-6))
    aggregates = [f for t in triples for f in (F.count_if(tested(*t)).alias("u%d_%d_%d" % t), F.count_if(F.coalesce(hit(*t), F.lit(False))).alias("h%d_%d_%d" % t))]
    whole = [F.avg(F.when(v(c).isNotNull(), (v(c) == F.floor(v(c))).cast("double"))).alias(f"w{c}") for c in range(n)]
    counts = rows.groupBy(*by).agg(*aggregates, *whole)
    scored = [
        F.when(F.col("u%d_%d_%d" % t) >= 2, F.struct((F.col("h%d_%d_%d" % t) / F.col("u%d_%d_%d" % t)).alias("ratio"), F.lit(t[2]).alias("amount"), F.lit(-t[0]).alias("q"), F.lit(-t[1]).alias("p"), F.col("u%d_%d_%d" % t).alias("usable"))) for t in triples
    ]
    best = counts.withColumn("b", F.array_max(F.array_compact(F.array(*scored)))).where("b is not null").select(*by, "b.*", F.array(*[f"w{c}" for c in range(n)]).alias("w"))
    swap = (F.col("ratio") > 0) & (F.get("w", -F.col("p")) > F.get("w", -F.col("q")) + 0.25)
    return best.select(*by, F.when(swap, -F.col("p")).otherwise(-F.col("q")).alias("qty"), F.when(swap, -F.col("q")).otherwise(-F.col("p")).alias("price"), "amount", F.round("ratio", 6).alias("ratio"), "usable")


def pivot_roles(cells: DataFrame, row: Sequence[str], role: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """A line item per row: the value of each role, null where the row has none; rows without any role drop out."""
    known = cells.where(F.col(role).isin(*names.values()))
    return known.groupBy(*row).agg(*[F.max(F.when(F.col(role) == r, F.col(value))).cast("double").alias(c) for c, r in names.items()])


def unique_roles(claims: DataFrame, by: Sequence[str], col: str, role: str, confidence: str, other: str = "UNKNOWN") -> DataFrame:
    """claims in which each role is claimed once: by the most confident column, of equals the rightmost; the rest get `other`."""
    w = Window.partitionBy(*by, role).orderBy(F.desc(confidence), F.desc(col))
    return claims.withColumn(role, F.when(F.row_number().over(w) == 1, F.col(role)).otherwise(other))
