"""Language-model scores by prediction by partial matching (PPM) over bytes.

A trie holds how often each byte followed each context of up to `order` bytes in the training texts, counted
by Spark over all of them. A byte seen in the longest known context has its share of the counts there, less
the escape of method C (distinct / (all + distinct)); an escape goes to the context shorter by one byte with the
symbols already tried excluded, and at last to all bytes evenly. Those probabilities are worked out once for every
(context, byte), so that scoring is a walk along arrays. The code length of a text, with an end symbol, is
added up per document.

The order is the same at any size, and so are the scores; only the way to the probabilities follows the size. Up to
`max_contexts` contexts of `order` bytes, each worker holds all of them. Beyond that the counts stay a table:
they are dealt out by the last bytes of the context, each group works out the probabilities of the strings that
the texts ask for, and these are joined to blocks of texts, which add them up. What must be known
everywhere then, counts after contexts shorter by two bytes or more, has 256 ** (order - 1) rows at most.

The base score is a smoothed word unigram model. The most frequent `head` words, a fixed number, go to the
workers; all other words are joined with the counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.common import crc32_of_id, shared_folder, written
from tablescribe.llm.tokens import _filesystem

#: Never a byte of UTF-8: stands before a text and ends it.
_EDGE = 0xFF
_CHUNK = 4 << 20
#: Contexts whose probabilities are worked out together: some MB at a time.
_ROWS = 2048


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with edges around them as one array, and where the symbols of each begin."""
    edge = bytes([_EDGE])
    data = np.frombuffer(b"".join(edge * order + t + edge for t in texts), np.uint8)
    sizes = np.array([len(t) + order + 1 for t in texts], np.int64)
    return data, np.cumsum(sizes) - sizes + order


def _groups(texts: pd.Series) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(_lowered(t))
        size += len(some[-1])
        if size >= _CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _grams(data: np.ndarray, order: int, starts: np.ndarray) -> np.ndarray:
    """Context and symbol of every symbol as one number, the symbol in the last byte."""
    key = np.zeros(len(data) - order, np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | data[j : j + len(key)]
    real = np.ones(len(data), bool)
    for j in range(1, order + 1):
        real[starts - j] = False
    return key[real[order:]]


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """docs (text) -> (gram, n): counts of strings of order bytes and the byte after them."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            for texts in _groups(b["text"]):
                data, starts = _padded(texts, order)
                k, n = np.unique(_grams(data, order, starts), return_counts=True)
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > 2_000_000:  # bounded memory; Spark adds up the rest
                    yield pd.DataFrame({"gram": keys.view(np.int64), "n": counts})
                    keys, counts = keys[:0], counts[:0]
        for i in range(0, len(keys), 100_000):
            yield pd.DataFrame({"gram": keys[i : i + 100_000].view(np.int64), "n": counts[i : i + 100_000]})

    return docs.select("text").mapInPandas(of, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame) -> DataFrame:
    """docs (text) -> (w, n): counts of lower-cased words."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def out() -> Iterator[pd.DataFrame]:
            words = list(counts)
            for i in range(0, len(words), 100_000):
                yield pd.DataFrame({"w": words[i : i + 100_000], "n": [counts[w] for w in words[i : i + 100_000]]})
            counts.clear()

        for b in batches:
            for t in b["text"]:
                counts.update(_lowered(t).split())
                if len(counts) > 500_000:
                    yield from out()
        yield from out()

    return docs.select("text").mapInPandas(of, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Trie:
    """PPM's probabilities for every context known and every byte, as log10."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, lower: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """lower: counts after contexts of order - 2 bytes, if grams are a part of all that has every context of
        order - 1 bytes either whole or not at all."""
        self.order = order
        every = grams if lower is None else lower[0]
        symbols = np.unique(every & np.uint64(255)).astype(np.int64)
        pads = np.unique(np.concatenate([symbols, [_EDGE]]))  # contexts may hold the edge even if no text is known
        self.size = len(pads) + 1  # and one for bytes never seen
        self.symbol = np.full(256, len(pads), np.int64)
        self.symbol[pads] = np.arange(len(pads))
        # how often each byte follows the last j bytes of the contexts: tables of the shorter contexts, a list for the longest, of
        # which there are most; its rows are laid out a few at a time
        tables, self.names = [], []
        for j in range(order):
            source, n = (grams, counts) if lower is None or j > order - 2 else lower
            known, row = np.unique(self._names(source, j), return_inverse=True)
            table = np.zeros((max(1, len(known)), self.size))
            np.add.at(table, (row, self._digit(source, 0)), n)
            tables.append(table)
            self.names.append(known if len(known) else np.zeros(1, np.int64))
        row = name = None
        name = self._names(grams, order)
        if (name[1:] < name[:-1]).any():
            by = np.argsort(name, kind="stable")
            name, grams, counts = name[by], grams[by], counts[by]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        self.names.append(name[new] if len(name) else np.zeros(1, np.int64))
        name = None
        first = np.concatenate([np.flatnonzero(new), [len(new)]]) if len(new) else np.zeros(2, np.int64)
        entries = (first, self._digit(grams, 0).astype(np.int16), counts)
        self.logs = [self._level(j, tables, self.names, entries) for j in range(order + 1)]
        self.steps = self._walks(self.names) if lower is None else []

    def _digit(self, grams: np.ndarray, back: int) -> np.ndarray:
        return self.symbol[((grams >> np.uint64(8 * back)) & np.uint64(255)).astype(np.int64)]

    def _names(self, grams: np.ndarray, j: int) -> np.ndarray:
        """The last j bytes of the contexts as numbers to the base `size`."""
        name = np.zeros(len(grams), np.int64)
        for back in range(j, 0, -1):
            name = name * self.size + self._digit(grams, back)
        return name

    def values(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the bytes before it."""
        out, left, last = np.zeros(len(grams)), np.arange(len(grams)), self._digit(grams, 0)
        for j in range(self.order, -1, -1):
            name = self._names(grams[left], j)
            row = np.minimum(np.searchsorted(self.names[j], name), len(self.names[j]) - 1)
            hit = self.names[j][row] == name if j else np.ones(len(left), bool)
            out[left[hit]] = self.logs[j][row[hit], last[left[hit]]]
            left = left[~hit]
        return out

    def _level(self, j: int, tables: list[np.ndarray], names: list[np.ndarray], entries: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(names[j]), self.size), np.float32)
        starts, symbol, count = entries
        for first in range(0, len(out), _ROWS):
            name = names[j][first : first + _ROWS]
            p = np.zeros((len(name), self.size))
            left = np.ones(len(name))
            tried = np.zeros((len(name), self.size), bool)
            for k in range(j, -1, -1):
                if k == self.order:
                    ends = starts[first : first + len(name) + 1]
                    c = np.zeros((len(name), self.size))
                    some = slice(ends[0], ends[-1])
                    np.add.at(c, (np.repeat(np.arange(len(name)), np.diff(ends)), symbol[some]), count[some])
                else:
                    shorter = name % (self.size**k) if k else np.zeros(len(name), np.int64)
                    c = np.where(tried, 0, tables[k][np.searchsorted(names[k], shorter)])
                n, d = c.sum(axis=1), (c > 0).sum(axis=1)
                some = np.maximum(n + d, 1)
                p += (left / some)[:, None] * c
                tried |= c > 0
                left = np.where(d > 0, left * d / some, left)
            unseen = 256 - tried.sum(axis=1)
            p += np.where(tried, 0, (left / np.maximum(unseen, 1))[:, None])
            out[first : first + _ROWS] = np.log10(np.maximum(p, 1e-300))
        return out

    def _walks(self, names: list[np.ndarray]) -> list[np.ndarray]:
        """steps[j][node of j bytes, byte]: the node of j + 1 bytes; the last row and value stand for unknown."""
        out = []
        nodes = [np.unique(names[self.order] // self.size ** (self.order - j)) for j in range(self.order + 1)]
        for j in range(self.order):
            step = np.full((len(nodes[j]) + 1, self.size), len(nodes[j + 1]), np.int32)
            parent = np.searchsorted(nodes[j], nodes[j + 1] // self.size)
            step[parent, nodes[j + 1] % self.size] = np.arange(len(nodes[j + 1]))
            out.append(step)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        if not texts:
            return np.empty(0)
        order = self.order
        data, starts = _padded(texts, order)
        s = self.symbol[data]
        n = len(s) - order
        node = np.zeros(n, np.int32)
        for j in range(order):
            node = self.steps[j][node, s[j : j + n]]
        known = node < len(self.logs[order])
        value = np.zeros(n, np.float64)
        value[known] = self.logs[order][node[known], s[order:][known]]
        at = np.flatnonzero(~known)
        for k in range(order - 1, -1, -1):  # the longest known end of a context that is unknown
            if not len(at):
                break
            name = np.zeros(len(at), np.int64)
            for d in range(order - k, order):
                name = name * self.size + s[at + d]
            row = np.minimum(np.searchsorted(self.names[k], name), len(self.names[k]) - 1)
            hit = self.names[k][row] == name
            value[at[hit]] = self.logs[k][row[hit], s[at[hit] + order]]
            at = at[~hit]
        # a text's symbols, edges before the next one left out
        total = np.concatenate(([0.0], np.cumsum(value)))
        first = starts - order
        return total[first + np.array([len(t) + 1 for t in texts])] - total[first]


@lru_cache(maxsize=1)
def load_trie(path: str, order: int) -> Trie:
    """From the counts in the shared folder; once for each worker."""
    fs, at = _filesystem(path)
    table = ds.dataset(at, filesystem=fs, format="parquet").to_table().combine_chunks()
    by = np.argsort(table.column("gram").to_numpy().view(np.uint64), kind="stable")
    grams, counts = table.column("gram").to_numpy().view(np.uint64)[by], table.column("n").to_numpy()[by].astype(float)
    del table, by
    trie = Trie(grams, counts, order)
    pa.default_memory_pool().release_unused()
    return trie


def _of_texts(data: np.ndarray, starts: np.ndarray, texts: list[bytes], order: int, values) -> np.ndarray:
    """Sums over the grams of each text of values(grams)."""
    value = values(_grams(data, order, starts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    total = np.concatenate(([0.0], np.cumsum(value)))
    return total[ends] - total[ends - [len(t) + 1 for t in texts]]


def shuffled_scores(docs: DataFrame, grams: DataFrame, order: int, block_bytes: int = 4 << 20) -> DataFrame:
    """docs (row, text) -> (row, score): log10 probabilities from counts (gram, n) that no worker holds whole."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    low = (1 << (8 * (order - 1))) - 1
    counts = grams.groupBy(F.col("gram").bitwiseAND(F.lit(low)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    lower = spark.sparkContext.broadcast((counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy().astype(float)))

    def asked(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.unique(_grams(*_swapped(texts, order))) for texts in _groups(pdf["text"])]
        return pd.DataFrame({"block": pdf["block"].iloc[0], "gram": np.unique(np.concatenate(found)).view(np.int64)})

    questions = written(blocked.groupBy("block").applyInPandas(asked, "block long, gram long"), "questions")
    shards = max(1, grams.count() // 100_000)
    shard = F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(low))), F.lit(shards)).alias("shard")

    def answer(known: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        known, want = known.sort_values("gram"), ask["gram"].to_numpy()
        trie = Trie(known["gram"].to_numpy().view(np.uint64), known["n"].to_numpy().astype(float), order, lower.value)
        return pd.DataFrame({"gram": want, "value": trie.values(want.view(np.uint64))})

    known, ask = grams.select(shard, "gram", "n"), questions.select("gram").distinct().select(shard, "gram")
    answers = known.groupBy("shard").cogroup(ask.groupBy("shard")).applyInPandas(answer, "gram long, value double")
    answered = questions.join(answers, "gram")

    def add(texts_of: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.assign(g=table["gram"].to_numpy().view(np.uint64)).sort_values("g")
        gram, value, out = table["g"].to_numpy(), table["value"].to_numpy(), []
        for texts in _groups(texts_of["text"]):
            data, starts = _padded(texts, order)
            out.append(_of_texts(data, starts, texts, order, lambda g: value[np.searchsorted(gram, g)]))
        return pd.DataFrame({"row": texts_of["row"], "score": np.concatenate(out)})

    return blocked.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(add, "row long, score double")


def _swapped(texts: list[bytes], order: int) -> tuple[np.ndarray, int, np.ndarray]:
    data, starts = _padded(texts, order)
    return data, order, starts


def train(docs: DataFrame, order: int = 4) -> tuple[str, DataFrame]:
    """Counts over docs (text), written to the shared folder: their path and the table."""
    path = f"{shared_folder(docs.sparkSession)}/grams"
    count_grams(docs, order).write.parquet(path)
    return path, docs.sparkSession.read.schema("gram long, n long").parquet(path)


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = 4, max_contexts: int = 1 << 18, head: int = 1 << 18) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the rows for which the condition held_out is false (default: crc32 of the id mod 10 is
    0). score is the log10 probability of the text, A-Z lowered, and its end under PPM; base_score that of its
    words and an end under the unigram model with 0.1 added to every count. Null texts are empty: only the end is
    scored. A null id counts as the empty text in the crc. Repeated rows train and are scored as often as they stand
    there. Without training rows every byte is equally likely. Texts of any length are scored whole. Other columns are ignored. An
    empty table gives an empty result. max_contexts (contexts that workers hold) and head (words that they hold) don't change
    the result.
    """
    spark = docs.sparkSession
    held = crc32_of_id(id_col) % 10 == 0 if held_out is None else held_out
    mine = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    training = mine.where(~F.col("held_out"))
    path, grams = train(training, order)
    fits = order == 1 or grams.select(F.shiftrightunsigned("gram", 8).alias("c")).distinct().count() <= max_contexts
    words = written(count_words(training), "words")
    ends = training.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    below = math.log10(n + 0.1 * (v + 1))
    # how many words occur so often: a row for each number of times; words above the least number that `head` allows
    often, so_far = None, 0
    for r in words.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        so_far += r["count"]
        if so_far > head:
            break
        often = r["n"]
    top = words.where(F.col("n") >= often).toLocalIterator() if often else []
    frequent = spark.sparkContext.broadcast({bytes(r["w"]): math.log10(r["n"] + 0.1) for r in top})
    end = math.log10(ends + 0.1)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, log, task, row = load_trie(path, order) if fits else None, frequent.value.get, TaskContext.get().partitionId(), 0
        for b in batches:
            first = 0
            for texts in _groups(b["text"]):
                out, rare = [], []
                for t in texts:
                    found = t.split()
                    logs = list(map(log, found))
                    if None in logs:
                        rest = Counter(w for w, x in zip(found, logs) if x is None)
                        rare.append([{"w": w, "times": k} for w, k in rest.items()])
                        logs = [x for x in logs if x is not None]
                    else:
                        rare.append([])
                    out.append((len(found) + 1, len(logs) + (ends > 0), math.fsum(logs) + end))
                part = b.iloc[first : first + len(texts)]
                yield pd.DataFrame(out, columns=["n_tokens", "known", "logs"]).assign(task=task, row=np.arange(row, row + len(texts)), id=part["id"].to_numpy(), held_out=part["held_out"].to_numpy(), score=trie.score(texts) if trie else 0.0, rare=rare, text=None if trie else [t.decode() for t in texts])
                first, row = first + len(texts), row + len(texts)

    # ids go through Python as text: beside a null, pandas would make doubles of them
    scored = written(mine.mapInPandas(of, "task long, row long, id string, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<w: binary, times: long>>, text string"), "scored")
    if not fits:
        place = F.shiftleft("task", 33).bitwiseOR(F.col("row")).alias("row")
        found = written(shuffled_scores(scored.select(place, "text"), grams, order), "found").select(F.shiftright("row", 33).alias("task"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "score")
        scored = scored.drop("score").join(found, ["task", "row"])
    rest = scored.select("task", "row", F.inline("rare")).join(words, "w", "left")
    rest = rest.groupBy("task", "row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("logs2"))
    both = scored.drop("rare", "text").join(rest, ["task", "row"], "left")
    return both.select(
        F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("logs2", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score",
    )
