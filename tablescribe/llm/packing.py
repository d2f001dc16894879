"""Packing token ids into fixed windows by non-negative least squares over length combinations.

Documents are packed in blocks: each task encodes its documents one after the other and packs them whenever it holds
`block` ids, so memory is bounded, ids are neither stored nor shuffled, and nothing passes through the driver. Whole
windows of a document are sequences of their own. The remainders, shorter than a window, are packed by the histogram
of their lengths: shallow combinations (pairs and triples) that fill a window exactly are laid out,
non-negative least squares finds how often to repeat each so that the histogram is used up, and the counts are
rounded as far as the histogram goes. What is left is packed greedily, longest first, one piece after the other, cut where
a sequence is full; so only the last sequence of a block is padded, and documents are cut twice at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.tokens import crc32_of, word_ids


def combinations(window: int, splits: int = 8) -> np.ndarray:
    """Pairs and triples of lengths that add up to the window, ascending, one a row; a pair starts with 0.

    All pairs, and for each length the triples whose second length is k / splits of the rest, k = 1 .. splits / 2.
    """
    a = np.arange(1, window // 2 + 1)
    rows = [np.stack([np.zeros_like(a), a, window - a], axis=1)]
    b = np.arange(1, window - 1)
    for k in range(1, splits // 2 + 1):
        c = np.maximum(1, (window - b) * k // splits)
        d = window - b - c
        rows.append(np.stack([b, c, d], axis=1)[d > 0])
    return np.unique(np.sort(np.concatenate(rows), axis=1), axis=0)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes A x closest to target, A's column j counting the lengths in row j of columns (0: none).

    Accelerated projected gradient; A has at most three entries a column and is never laid out.
    """
    n, m = len(target), columns.shape[1]
    real = columns > 0
    uses = np.bincount(columns.ravel(), minlength=n)[1:]
    step = 1.0 / max(1, m * 2 * int(uses.max(initial=1)))  # above the largest eigenvalue of A'A: column sum times row sum
    x = y = np.zeros(len(columns))
    t = 1.0
    target = target.astype(float)
    for _ in range(rounds):
        made = np.bincount(columns.ravel(), weights=np.repeat(y, m), minlength=n)
        gradient = ((made - target)[columns] * real).sum(axis=1)
        new = np.maximum(0, y - step * gradient)
        if gradient @ (new - x) > 0:  # momentum points uphill: start anew
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max(initial=0) < 1e-6:
            x = new
            break
        x, t = new, t_new
    return x


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where pieces shorter than the window go: sequence and offset of each, and how many sequences there are. A
    piece that reaches beyond its sequence goes on at the start of the next one."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    n = np.bincount(lengths, minlength=window + 1)[: window + 1]
    first = np.cumsum(n) - n  # of each length, in order
    left, used = n.copy(), 0
    columns = combinations(window)
    columns = columns[((columns == 0) | (left[columns] > 0)).all(axis=1)]
    if len(columns):
        x = nnls(columns, left[:window])
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            parts = [int(v) for v in columns[j] if v]
            times = min(int(x[j] + 0.5), *(int(left[v]) // parts.count(v) for v in parts))
            at = 0
            for v in parts if times else []:
                here = order[first[v] + n[v] - left[v] :][:times]
                sequence[here], offset[here] = np.arange(used, used + times), at
                left[v] -= times
                at += v
            used += times
    rest = np.concatenate([order[first[v] + n[v] - left[v] : first[v] + n[v]] for v in range(window - 1, 0, -1) if left[v]] or [order[:0]])
    position = np.cumsum(lengths[rest]) - lengths[rest]
    sequence[rest], offset[rest] = used + position // window, position % window
    return sequence, offset, used + int(-(-lengths[rest].sum() // window))


def pack_block(sizes: np.ndarray, window: int) -> tuple[pd.DataFrame, int]:
    """Pieces (doc, start, length, sequence, offset) of documents with so many ids each, and how many sequences they fill."""
    doc = np.arange(len(sizes))
    whole, rest = sizes // window, sizes % window
    short = np.flatnonzero(rest)
    sequence, offset, used = place(rest[short], window)
    room = np.minimum(rest[short], window - offset)
    parts = [pd.DataFrame({"doc": short, "start": sizes[short] - rest[short], "length": room, "sequence": sequence, "offset": offset})]
    cut = room < rest[short]
    parts.append(pd.DataFrame({"doc": short[cut], "start": (sizes[short] - rest[short] + room)[cut], "length": (rest[short] - room)[cut], "sequence": sequence[cut] + 1, "offset": 0}))
    full = np.repeat(doc, whole)
    nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    parts.append(pd.DataFrame({"doc": full, "start": nth * window, "length": window, "sequence": used + np.arange(len(full)), "offset": 0}))
    return pd.concat(parts, ignore_index=True).sort_values(["doc", "start"], ignore_index=True), used + len(full)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block: int = 1 << 24) -> DataFrame:
    """A row per piece: id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (where the piece starts in its sequence), and with_ids the ids as little-endian bytes.

    sequence_id holds the task in its upper bits and the sequence's number there in the lower 33. Null texts are empty: their one
    id, the end, is a document. Each row is a document of its own, also if it repeats another's id. A document
    longer than a block is a block of its own. Other columns of docs are ignored. An empty table gives an empty result.
    """
    if window < 4:
        raise ValueError("window must be 4 or more")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, sequences = word_ids(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([end_id], ids_of.type).tobytes()
        names_held, held, size = [], [], 0

        def done() -> Iterator[pd.DataFrame]:
            nonlocal sequences
            sizes = np.array([len(x) for x in held], np.int64)
            pieces, used = pack_block(sizes, window)
            for i in range(0, len(pieces), 20_000):
                p = pieces.iloc[i : i + 20_000]
                parts = [held[d][s : s + n] for d, s, n in zip(p["doc"], p["start"], p["length"])]
                out = p[["start", "length", "offset"]].assign(
                    id=pd.Series(names_held, dtype=object).iloc[p["doc"]].to_numpy(), ids_crc32=[crc32_of(x) for x in parts], doc_tokens=sizes[p["doc"]], sequence_id=p["sequence"] + sequences
                )
                yield (out.assign(ids=[x.astype("<u4").tobytes() for x in parts]) if with_ids else out)[names]
            sequences += used
            names_held.clear()
            held.clear()

        for b in batches:
            for doc, text in zip(b["id"].astype(object), b["text"]):
                held.append(np.frombuffer(ids_of.of(text) + end, ids_of.type))
                names_held.append(None if pd.isna(doc) else doc)
                size += len(held[-1])
                if size >= block:
                    yield from done()
                    size = 0
        if held:
            yield from done()

    schema = "id string, " + ", ".join(f"{c} long" for c in names[1:7]) + ", ids binary" * with_ids
    # ids go through Python as text: beside a null, pandas would make doubles of them
    packed = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(of, schema)
    return packed.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col)
