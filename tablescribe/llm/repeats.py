"""Exact substring deduplication: distributed prefix doubling over anchored suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts anywhere else. A suffix array
over every position would be many times the corpus, so ranks are kept for anchors: the anchor of a start p
is the position of the least k-gram hash among p .. p + length/2 - 1, the first of equals. It depends on the
string at p alone, so equal strings have their anchors at equal offsets, and starts with one anchor form a
block (one per 100 bytes at length 400). Equal strings agree in at least length/2 bytes from the anchor on.

Prefix doubling: in round r the rank of the first m bytes at an anchor is paired with the name (64-bit
hash) of the m bytes at offset m; Spark sorts the pairs, pairs that occur once are dropped as unique, the
others are ranked anew for 2 m bytes, from length/8 to length/2. What is left is cut into blocks: equal
blocks (all strings of `length` bytes with that anchor) repeat as a whole; where blocks with one rank
differ, cells of 16 starts are compared in the same way, by what their strings share and by all their bytes, and
the starts of cells that agree in part take part in a last round at full length. One block stands for its equals.

Work is linear in the input at any size of groups: groups are counted, not collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.common import written

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240901).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once; longer texts are cut, with an overlap of `length` bytes. Positions take _BITS bits.
_CHUNK, _BITS = 1 << 20, 22
#: Starts in a cell: where blocks differ, whole cells are compared before single starts.
_CELL = 16
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        p = np.full(n + (1 << 16), base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


class Hashes:
    """64-bit hashes of any substring of a byte string."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power("up", _BASE, self.n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, self.n + 1)

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def run(self, lo: int, hi: int, size: int) -> np.ndarray:
        """Of the starts lo .. hi - 1."""
        h = (self.sums[lo + size : hi + size] - self.sums[lo:hi]) * self.down[lo:hi]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    return np.minimum(v[: len(v) - (w - s)], v[w - s :]) if s < w else v


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's number, first byte, bytes) of about _CHUNK bytes; only texts of `length` bytes or more."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _CHUNK):
            part = t[at : at + _CHUNK + length - 1]
            if len(part) >= length:
                some.append((i, at, part))
                size += len(part)
            if size >= _CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def anchored_blocks(texts: list[bytes], length: int) -> Iterator[dict[str, np.ndarray]]:
    """The blocks of the texts: text's number, first and last start, three names at the anchor, hash of all."""
    w, q, k = length // 2, length // 8, min(32, length // 4)
    for pieces in _pieces(texts, length):
        sizes = np.array([len(p) for *_, p in pieces])
        data = np.frombuffer(b"".join(p for *_, p in pieces), np.uint8)
        h, n = Hashes(data), len(data)
        v = h.run(0, n - k + 1, k)
        v = (v & ~np.uint64((1 << _BITS) - 1)) | np.arange(len(v), dtype=np.uint64)
        anchor = (_sliding_least(v, w)[: n - length + 1] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)[: n - length + 1]
        inside = ends - np.arange(n - length + 1) >= length
        changes = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
        valid = np.diff(inside.astype(np.int8), prepend=0) != 0  # a text's starts begin or end here
        begins = np.union1d(changes, np.flatnonzero(valid))
        last = np.append(begins[1:], n - length + 1) - 1
        good = inside[begins]
        lo, hi = begins[good], last[good]
        a = anchor[lo]
        which = np.searchsorted(np.cumsum(sizes), lo, side="right")
        shift = np.array([at for _, at, _ in pieces]) - (np.cumsum(sizes) - sizes)
        whole = h.of(lo, hi - lo + length) ^ ((hi - lo).astype(np.uint64) * _BASE) ^ ((a - lo).astype(np.uint64) * _MIX)
        yield {
            "i": np.array([i for i, *_ in pieces])[which], "lo": lo + shift[which], "hi": hi + shift[which], "a": a + shift[which],
            "n0": h.of(a, q).view(np.int64), "n1": h.of(a + q, q).view(np.int64), "n2": h.of(a + 2 * q, 2 * q).view(np.int64), "whole": whole.view(np.int64),
        }


def _slices(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch some MB at a time: (first number, bytes)."""
    first, some, size = 0, [], 0
    for i, t in enumerate(texts):
        some.append(t.encode() if t else b"")
        size += len(some[-1])
        if size >= 4 * _CHUNK:
            yield first, some
            first, some, size = i + 1, [], 0
    if some:
        yield first, some


def _anchors(docs: DataFrame, length: int, names_only: bool) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, th = b["id"].to_numpy() if not names_only else None, b["th"].to_numpy() if not names_only else None
            for first, texts in _slices(b["text"]):
                for x in anchored_blocks(texts, length):
                    if names_only:
                        names, counts = np.unique(x["n0"], return_counts=True)
                        yield pd.DataFrame({"n0": names, "n": counts})
                    else:
                        i = x.pop("i") + first
                        yield pd.DataFrame({"id": ids[i], "th": th[i], **x})

    if names_only:
        return docs.select("text").mapInPandas(of, "n0 long, n long")
    return docs.mapInPandas(of, "id long, th long, lo long, hi long, a long, n0 long, n1 long, n2 long, whole long")


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from lo to hi of each pair, and the pair it is of."""
    n = hi - lo + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()), of


def _near(first: np.ndarray) -> Iterator[slice]:
    """Slices of ascending first bytes that span some _CHUNK bytes at most, so that a very long text is hashed in parts."""
    at = 0
    while at < len(first):
        to = int(np.searchsorted(first, first[at] + 2 * _CHUNK))
        yield slice(at, to)
        at = to


def _of_texts(blobs: pd.Series, lists: pd.Series, keys: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Row, bytes and the fields of the row's list as arrays, by ascending lo."""
    for row, (blob, items) in enumerate(zip(blobs, lists)):
        fields = [np.array([x[k] for x in items], np.int64) for k in keys]
        order = np.argsort(fields[0], kind="stable")
        yield row, np.frombuffer(zstandard.decompress(blob), np.uint8), [f[order] for f in fields]


def _cells(length: int):
    """Blocks of a text -> cells: up to _CELL neighbouring starts at fixed distances from the anchor. core is a hash of
    the bytes that all strings starting in such a cell share, whole one of all their bytes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ths = b["id"].to_numpy(), b["th"].to_numpy()
            for row, data, (lo, hi, anchor, n) in _of_texts(b["blob"], b["asked"], ("lo", "hi", "a", "n")):
                for part in _near(lo):
                    first = int(lo[part][0])
                    h = Hashes(data[first : int(anchor[part].max()) + length])
                    far, near = (anchor[part] - lo[part]) // _CELL, (anchor[part] - hi[part]) // _CELL
                    g, k = _expanded(near, far)
                    last = anchor[part][k] - g * _CELL
                    start, end = np.maximum(lo[part][k], last - _CELL + 1), np.minimum(hi[part][k], last)
                    salt = g.astype(np.uint64) * _BASE
                    core = h.of(last - first, length - _CELL + 1) ^ salt
                    whole = h.of(start - first, end - start + length) ^ ((last - start).astype(np.uint64) * _MIX) ^ ((end - start).astype(np.uint64) * _BASE)
                    yield pd.DataFrame({"id": ids[row], "th": ths[row], "lo": start, "hi": end, "core": core.view(np.int64), "whole": whole.view(np.int64), "n": np.minimum(n[part][k], 2)})

    return of


def _windows(length: int):
    """Cells of a text -> a row for each start in them, with the hash of its string."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ths = b["id"].to_numpy(), b["th"].to_numpy()
            for row, data, (lo, hi, n) in _of_texts(b["blob"], b["asked"], ("lo", "hi", "n")):
                for part in _near(lo):
                    first = int(lo[part][0])
                    h = Hashes(data[first : int(hi[part].max()) + length])
                    start, k = _expanded(lo[part], hi[part])
                    yield pd.DataFrame({"id": ids[row], "th": ths[row], "lo": start, "h": h.of(start - first, length).view(np.int64), "n": n[part][k]})

    return of


def packed_text(text: Column) -> Column:
    """Compressed UTF-8 bytes: what is shuffled instead of texts."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for texts in batches:
            yield pd.Series([pack(t.encode() if t else b"") for t in texts], dtype=object)

    return of(text)


def repeated_starts(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs (id, th, text) -> (id, th, lo, hi): runs of starts of strings of `length` bytes that start elsewhere too.

    id and th, hashes of the row's id and of its text, name the row; rows that agree in both have one text.
    """
    names = _anchors(docs, length, True).groupBy("n0").agg(F.sum("n").alias("n")).where("n > 1")
    left = _anchors(docs, length, False)
    left = written(left.join(names.select("n0"), "n0", "left_semi").withColumnRenamed("n0", "rank"), "round0")
    for r in (1, 2):  # (rank of the first m bytes, name of the next m): sort, drop the unique, rank anew
        name = f"n{r}"
        pairs = left.groupBy("rank", name).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        ranks = written(pairs.orderBy("rank", name).withColumn("next", F.monotonically_increasing_id()), "ranks")
        left = left.join(ranks, ["rank", name]).drop("rank", name).withColumnRenamed("next", "rank")
    left = written(left, "anchors")
    blocks = left.groupBy("rank", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "lo", "hi", "a")).alias("at"))
    blocks = written(blocks, "blocks")
    mixed = blocks.groupBy("rank").agg(F.count("*").alias("d")).where("d > 1").select("rank")
    equal = left.join(blocks.where("n > 1").select("rank", "whole"), ["rank", "whole"], "left_semi").select("id", "th", "lo", "hi")
    differing = blocks.join(mixed, "rank", "left_semi").select("at.*", "n")

    texts = docs.select("id", "th", packed_text(F.col("text")).alias("blob"))
    by_text = lambda rows, *columns: rows.groupBy("id", "th").agg(F.collect_list(F.struct(*columns)).alias("asked"))  # noqa: E731  at most a text's own
    texts = written(texts.join(by_text(differing, "lo", "hi", "a", "n"), ["id", "th"]).dropDuplicates(["id", "th"]), "texts")
    cells = written(texts.mapInPandas(_cells(length), "id long, th long, lo long, hi long, core long, whole long, n long"), "cells")
    cores = cells.groupBy("core").agg(F.sum("n").alias("c"), F.min("whole").alias("x"), F.max("whole").alias("y")).where("c > 1").select("core", (F.col("x") == F.col("y")).alias("same"))
    shared = written(cells.join(cores, "core").drop("core", "whole"), "shared")
    whole = shared.where("same and n = 1").select("id", "th", "lo", "hi")

    windows = texts.select("id", "th", "blob").join(by_text(shared.where("not same"), "lo", "hi", "n"), ["id", "th"])
    windows = written(windows.mapInPandas(_windows(length), "id long, th long, lo long, h long, n long"), "windows")
    again = windows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    single = windows.where("n = 1").join(again, "h", "left_semi").select("id", "th", "lo", F.col("lo").alias("hi"))
    return equal.unionAll(whole).unionAll(single)


def spans_of(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes covered by strings that start at lo .. hi."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) and
    spans (first byte, end) that went.

    Strings are compared as UTF-8 bytes within and across the texts, never across a border; null counts as
    empty. Texts shorter than `length` bytes lose nothing. Rows that repeat a text repeat its strings, also if they
    share its id. Other columns of docs are ignored. An empty table gives an empty result. `kept` may cut a
    character in two, since strings are of bytes.
    """
    if length < 16:
        raise ValueError("length must be 16 bytes or more")
    mine = docs.select(F.col(id_col).cast("string").alias("name"), F.xxhash64(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    starts = repeated_starts(mine, length)
    per_text = starts.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # at most a text's own
    both = mine.select("name", "id", "th", packed_text(F.col("text")).alias("blob")).join(per_text, ["id", "th"], "left").select(F.col("name").alias("id"), "blob", "runs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for blob, runs in zip(b["blob"], b["runs"]):
                data = zstandard.decompress(blob)
                spans = spans_of([(r["lo"], r["hi"]) for r in runs], length) if runs is not None else []
                at, kept = 0, []
                for lo, hi in spans:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"first": lo, "end": hi} for lo, hi in spans]))
            yield pd.DataFrame({"id": b["id"], **dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"), zip(*out)))}) if out else pd.DataFrame()

    out = both.mapInPandas(cut, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<first: long, end: long>>")
    return out.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col)  # through Python as text: beside a null, pandas would make doubles of them
