"""Cosines of all pairs of vectors within a group, a block of vectors against another at a time.

Vectors are dealt into blocks by a hash of their ids, and each two blocks of a group meet in one task's arrays, so a group may be of
any size. Products are added up in the order of the components, as a loop over them does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescribe.operators.joins import sorted_side

#: Vectors of a block, as many as hash to it on average, and how many of them are compared with another block in one go.
_BLOCK, _ROWS = 1024, 64


def block_pairs(vectors: DataFrame, by: Sequence[str], id_col: str, vector: str) -> DataFrame:
    """(by, n, i, j, id, own, v): each vector in every pair of blocks (i <= j) of its group and length n that its own block is in.
    Vectors that are null or hold a null, and those without id or group, are left out: they have no cosine."""
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    for c in by:
        usable = usable & F.col(c).isNotNull()
    known = vectors.where(usable).select(*by, F.size(vector).alias("n"), F.col(id_col).alias("id"), F.col(vector).alias("v"))
    blocks = known.groupBy(*by, "n").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    dealt = known.join(sorted_side(blocks), [*by, "n"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select(*by, "n", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "own", "v")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the first axis, in its order."""
    out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
    for x, y in zip(a, b):
        out += x * y
    return out


def cosines(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and ids and the cosines of the one with the other: the two blocks of a pair, or a block with itself, some rows at a time."""
    pdf = pdf.sort_values("id")
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    a, b = (pdf, pdf) if same else (pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]])
    if not len(a) or not len(b):
        return
    # components first: a row of the array is one component of all vectors
    x, y = (np.array(d["v"].tolist(), dtype=float).reshape(len(d), -1).T.copy() for d in (a, b))
    with np.errstate(all="ignore"):
        long, wide = np.sqrt(_dot(x, x)), np.sqrt(_dot(y, y))
        for k in range(0, len(a), _ROWS):
            part = slice(k, k + _ROWS)
            yield a["id"].to_numpy()[part], b["id"].to_numpy(), _dot(x[:, part, None], y[:, None, :]) / (long[part, None] * wide + 1e-10)


def over_blocks(pairs: DataFrame, by: Sequence[str], of: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What `of` yields for the two blocks of each pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [f for f in of(pdf) if len(f)]
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return pairs.groupBy(*by, "n", "i", "j").applyInPandas(run, schema)


def alike(vectors: DataFrame, by: Sequence[str], id_col: str, vector: str, least: float) -> DataFrame:
    """(a, b, c): pairs of a group, a < b, with a cosine of `least` or more, or none that is a number."""

    def of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        for a, b, c in cosines(pdf):
            r, s = np.nonzero(~(c < least) & ((a[:, None] < b) if same else (a[:, None] != b)))
            yield pd.DataFrame({"a": np.minimum(a[r], b[s]), "b": np.maximum(a[r], b[s]), "c": c[r, s]})

    kind = dict(vectors.dtypes)[id_col]
    return over_blocks(block_pairs(vectors, by, id_col, vector), by, of, f"a {kind}, b {kind}, c double")


def nearest_two(vectors: DataFrame, by: Sequence[str], id_col: str, vector: str, margin: float) -> DataFrame:
    """(id, other, c): for each vector and block the two nearest others, with those that are farther by `margin` at most; of one's equal
    cosines the two smallest ids. A cosine that is no number counts as the nearest."""

    def best(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        key = np.where(np.isnan(c), np.inf, c)
        key[a[:, None] == b] = -np.inf
        last = np.partition(key, -2, axis=1)[:, -2] if key.shape[1] > 1 else key[:, 0]
        r, s = np.nonzero((key >= (last - margin)[:, None]) & (key > -np.inf))
        order = np.lexsort((b[s], -key[r, s], r))
        r, s = r[order], s[order]
        again = np.zeros(len(r), dtype=bool)  # the third and later of one's equal cosines
        again[2:] = (r[2:] == r[:-2]) & (key[r[2:], s[2:]] == key[r[:-2], s[:-2]])
        return pd.DataFrame({"id": a[r], "other": b[s], "c": c[r, s]})[~again]

    def of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for a, b, c in cosines(pdf):
            yield best(a, b, c)
            if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
                yield best(b, a, c.T)

    kind = dict(vectors.dtypes)[id_col]
    return over_blocks(block_pairs(vectors, by, id_col, vector), by, of, f"id {kind}, other {kind}, c double")
