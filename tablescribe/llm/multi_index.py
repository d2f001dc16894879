"""Near-duplicate embeddings by an inverted multi-index.

Each half of the vectors has a codebook of its own; the pairs of codewords form a grid of cells, and a vector
lies in the cell of its nearest codewords. A search visits cells by the sum of its squared distances to
their two codewords, nearest first (multi-sequence order), and compares with the vectors there by exact
cosine. How many cells are visited is measured: `probes` vectors are compared with all others, and the number is
the least at which their links reach `recall`, also for links that the probes lack because they are rare: each probe
is turned in random directions to exactly the least cosine, and the turned vectors must be found as often. A link is
found if either end visits the other's cell.

Equal vectors are one class with a number of copies. The codebooks are fitted on a bounded sample
(`sample` classes); every class is indexed and searched. Small cells with near codewords share a region, to which a
search goes once. Regions with many members are dealt out in blocks of members and of searches, so that no task holds more than `block` x `batch` of them, and a block reports numbers of links and a
spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.common import components, written


def unit(vectors: pd.Series | list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    x = x.reshape(len(x), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1))


def _codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means."""
    rng = np.random.default_rng(seed)
    book = np.unique(x, axis=0)
    book = book[rng.permutation(len(book))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, book).argmin(axis=1)
        size = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book[size > 0] = total[size > 0] / size[size > 0, None]
    return book


@dataclass
class Index:
    """Two codebooks, and how many cells a search visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1
    near: np.ndarray | None = None  # the region of each second codeword, within those of the first

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (u.shape[1] + 1) // 2
        right = u[:, h:] if u.shape[1] > h else np.zeros((len(u), 1))
        return _distances(u[:, :h], self.first), _distances(right, self.second)

    def nearest(self, u: np.ndarray) -> np.ndarray:
        """The cells that each vector visits, nearest first.

        In multi-sequence order the cell of the a-th nearest first and b-th nearest second codeword comes after
        all (a + 1)(b + 1) - 1 cells that are no further in either; so only those up to `visits` can come up.
        """
        d1, d2 = self.halves(u)
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        v = min(self.visits, self.cells)
        a, b = np.nonzero(np.outer(np.arange(1, d1.shape[1] + 1), np.arange(1, d2.shape[1] + 1)) <= v)
        d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        best = (d1[:, a] + d2[:, b]).argsort(axis=1, kind="stable")[:, :v]
        return np.take_along_axis(o1, a[best], 1) * len(self.second) + np.take_along_axis(o2, b[best], 1)

    def regions(self, cells: np.ndarray) -> np.ndarray:
        """The region of each cell; without regions every cell is its own."""
        a, b = np.divmod(cells, len(self.second))
        return cells if self.near is None else a * (int(self.near.max()) + 1) + self.near[b]

    def home(self, u: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        d1, d2 = self.halves(u)
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def ranks(self, u: np.ndarray) -> np.ndarray:
        """For each vector, the place of every cell in its order."""
        d1, d2 = self.halves(u)
        order = (d1[:, :, None] + d2[:, None, :]).reshape(len(u), -1).argsort(axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        return place


def forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links hits[i, j] of left[i] and right[j] connect: a star for each component."""
    out, open_left = [], hits.any(axis=1)
    while open_left.any():
        new_left = np.zeros(len(left), bool)
        new_left[open_left.argmax()] = True
        in_left, in_right = new_left, np.zeros(len(right), bool)
        while new_left.any():
            new_right = hits[new_left].any(axis=0) & ~in_right
            in_right = in_right | new_right
            new_left = hits[:, new_right].any(axis=1) & ~in_left
            in_left = in_left | new_left
        members = np.unique(np.concatenate([left[in_left], right[in_right]]))
        out += [(int(members[0]), int(m)) for m in members[1:]]
        open_left = open_left & ~in_left
    return out


def visits_at(index: Index, u: np.ndarray, cosine: float, recall: float, turns: int = 4, seed: int = 17) -> int:
    """How many cells either end must visit so that pairs at exactly this cosine, in random directions, reach `recall`."""
    if not -1 < cosine < 1 or u.shape[1] < 2:
        return 1
    rng, rows, found = np.random.default_rng(seed), np.arange(len(u)), []
    own, place = index.home(u), index.ranks(u)
    for _ in range(turns):
        side = rng.normal(size=u.shape)
        side -= (side * u).sum(axis=1)[:, None] * u
        turned = cosine * u + math.sqrt(1 - cosine * cosine) * side / np.sqrt((side * side).sum(axis=1))[:, None]
        found.append(np.minimum(place[rows, index.home(turned)], index.ranks(turned)[rows, own]))
    return int(np.quantile(np.concatenate(found), recall, method="higher")) + 1


def _train(classes: DataFrame, n: int, sample: int, probes: int, recall: float, cosine: float, size: int, block: int) -> Index:
    order = F.xxhash64("cid", F.lit(11))
    some = unit([r["v"] for r in classes.select("v", "cid").orderBy(order, "cid").limit(sample).toLocalIterator()])
    k = int(min(256, max(2, math.sqrt(n / size))))
    h = (some.shape[1] + 1) // 2
    index = Index(_codebook(some[:, :h], k), _codebook(some[:, h:] if some.shape[1] > h else np.zeros((len(some), 1)), k))
    asked = classes.select("v", "cid").orderBy(F.xxhash64("cid", F.lit(13)), "cid").limit(probes).collect()
    u, ids = unit([r["v"] for r in asked]), np.array([r["cid"] for r in asked])
    at = classes.sparkSession.sparkContext.broadcast((index, u, ids))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, u, ids = at.value
        place = index.ranks(u)
        found = np.zeros(place.shape, np.int64)
        for b in batches:
            x = unit(b["v"])
            cell = index.home(x)
            q, y = np.nonzero((u @ x.T >= cosine) & (ids[:, None] != b["cid"].to_numpy()[None, :]))
            np.add.at(found, (q, place[q, cell[y]]), 1)
        q, p = np.nonzero(found)
        yield pd.DataFrame({"q": q, "place": p, "n": found[q, p]})

    seen = classes.select("v", "cid").mapInPandas(linked, "q long, place long, n long").groupBy("q", "place").agg(F.sum("n").alias("n")).toPandas()
    if len(seen):  # every probe with links weighs the same
        seen["share"] = seen["n"] / seen.groupby("q")["n"].transform("sum")
        by_place = seen.groupby("place")["share"].sum().sort_index()
        reached = by_place.cumsum() / by_place.sum()
        index.visits = int(reached.index[(reached >= recall).to_numpy().argmax()]) + 1
    index.visits = min(index.cells, max(4, index.visits, visits_at(index, u, cosine, recall)))
    groups = min(len(index.second), math.ceil(n / len(index.first) / block))  # a region holds about a block
    index.near = _distances(index.second, _codebook(index.second, groups)).argmin(axis=1)
    return index


def _compare(cosine: float):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        q, y = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(q) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "int64", "b": "Int64", "links": "int64"})
        qi, yi, nq, ny = q["cid"].to_numpy(), y["cid"].to_numpy(), q["n"].to_numpy(), y["n"].to_numpy()
        qu, yu, own, at = unit(q["v"]), unit(y["v"]), q["cell"].to_numpy(), y["cell"].to_numpy()
        visited = np.stack(y["visited"].to_numpy())
        links_q, links_y, edges = np.zeros(len(q), np.int64), np.zeros(len(y), np.int64), []
        wanted = np.concatenate(q["visited"].to_numpy())
        asker = np.repeat(np.arange(len(q)), q["visited"].map(len).to_numpy())
        by_cell = wanted.argsort(kind="stable")
        wanted, asker = wanted[by_cell], asker[by_cell]
        for cell in np.unique(at):
            i, j = asker[np.searchsorted(wanted, cell) : np.searchsorted(wanted, cell, "right")], np.flatnonzero(at == cell)
            if not len(i):
                continue
            hits = (qu[i] @ yu[j].T >= cosine) & (qi[i][:, None] != yi[j][None, :])
            if not hits.any():
                continue
            links_q[i] += hits @ ny[j]
            # a member that doesn't visit the searcher's cell itself learns of the link here
            for c in np.unique(own[i][hits.any(axis=1)]):
                unaware = ~(visited[j] == c).any(axis=1)
                if unaware.any():
                    links_y[j[unaware]] += nq[i][own[i] == c] @ hits[np.ix_(own[i] == c, unaware)]
            edges += forest(hits, qi[i], yi[j])
        ids, links = np.concatenate([qi, yi]), np.concatenate([links_q, links_y])
        some = links > 0
        return pd.DataFrame({
            "a": np.concatenate([ids[some], np.array([a for a, _ in edges], np.int64)]),
            "b": pd.array([None] * int(some.sum()) + [b for _, b in edges], dtype="Int64"),
            "links": np.concatenate([links[some], np.zeros(len(edges), np.int64)]),
        })

    return of


def _linked(classes: DataFrame, n: int, kind: str, cosine: float, recall: float, sample: int, probes: int, cell_size: int, block: int, batch: int) -> DataFrame:
    """(v, links, component) of n distinct vectors of one length (cid, v, least id, n rows)."""
    index = _train(classes, n, sample, probes, recall, cosine, cell_size, block)
    at = classes.sparkSession.sparkContext.broadcast(index)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                cells = at.value.nearest(unit(part["v"]))
                regions = at.value.regions(cells)
                asked = [[{"at": r, "cells": c[g == r]} for r in np.unique(g)] for c, g in zip(cells, regions)]
                yield part.assign(cell=cells[:, 0], region=regions[:, 0], visited=list(cells), asked=asked)

    indexed = written(classes.select("cid", "n", "v").mapInPandas(placed, f"cid long, n long, v {kind}, cell int, region int, visited array<int>, asked array<struct<at: int, cells: array<int>>>"), "indexed")
    visits = indexed.select(F.explode("asked.at").alias("at")).groupBy("at").agg(F.count("*").alias("asked"))
    members = indexed.groupBy(F.col("region").alias("at")).agg(F.count("*").alias("held"))
    # a row per region, 65,536 at most
    grid = written(members.join(visits, "at").select("at", F.ceil(F.col("held") / block).alias("blocks"), F.ceil(F.col("asked") / batch).alias("batches")), "grid")
    part = lambda of, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    held = indexed.withColumn("at", F.col("region")).join(F.broadcast(grid), "at").withColumn("mb", part("blocks", 1)).withColumn("qb", every("batches")).withColumn("asks", F.lit(False))
    asks = indexed.select("cid", "n", "v", "cell", F.inline("asked")).withColumnRenamed("cells", "visited").join(F.broadcast(grid), "at").withColumn("qb", part("batches", 2)).withColumn("mb", every("blocks")).withColumn("asks", F.lit(True))
    columns = ["at", "mb", "qb", "asks", "cid", "n", "v", "cell", "visited"]
    both = held.select(*columns).unionAll(asks.select(*columns))
    found = written(both.groupBy("at", "mb", "qb").applyInPandas(_compare(cosine), "a long, b long, links long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = classes.select("cid", "v", "least", "n").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.99, sample: int = 8192, probes: int = 256,
    cell_size: int = 16, block: int = 512, batch: int = 4096,
) -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    kept: the id is the component's. Vectors that are null, empty, all zero, or hold a null or a non-finite
    number link with nothing; the others link with vectors of their length, each length with an index of its own. Rows that repeat a vector are linked, also if they share
    its id. A null id counts only where its component has no other. Other columns are ignored. An empty table gives an
    empty result.
    """
    v = F.col("v")
    fit = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v")).withColumn("v", F.when(fit, v)), "vectors")
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")), "lengths")
    lengths = classes.groupBy(F.size("v").alias("size")).count().orderBy("size").collect()  # a row per length
    no_links = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return no_links
    named = None
    for length in lengths:
        own = written(classes.where(F.size("v") == length["size"]).withColumn("cid", F.monotonically_increasing_id()), "classes")
        linked = _linked(own, length["count"], kind, cosine, recall, sample, probes, cell_size, block, batch)
        named = named.unionAll(linked) if named is not None else linked
    out = rows.join(named, "v", "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
