"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the bytes of words, one of toxic and one of ordinary labelled texts.
A byte is predicted from up to `order` bytes before it in its word. Long contexts count the documents of a class
that have the word, shorter ones the different bytes before them, so that copies and repeats within a text don't add up. At
every context length both classes back off to one model whose counts they share: an expression seen too
rarely to tell the classes apart gets almost the same likelihood from both, and its ratio says little.

A text is compared by its length-normalised likelihoods: the log-likelihood ratio of each word (toxic over
ordinary), of which only what exceeds 0, 2 and 3 nats is added up, divided by the number of words. A logistic
curve over the square roots of these three, fitted on labelled texts that the models haven't seen, turns them into a
score between 0 and 1.

The models are fitted on a bounded sample (`per_class` labelled rows of either class at most, the first
by a hash of the id); every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.common import crc32_of_id, written

_EDGES = b".,;:!?\"'()[]{}|<>*#$%&-_"
#: What a word's ratio must exceed, and the most that counts beyond it.
EXCESS = ((0.0, 1e9), (2.0, 6.0), (3.0, 9.0))
#: Words added to a text's number of words, so that a few words alone prove nothing.
PAD = 10
#: Curve where the labelled rows hold one class only.
PRIOR = (0.0, 15.0, 15.0, -10.0)
#: Words remembered by a worker; beyond that it starts anew, so memory stays bounded.
_REMEMBERED = 500_000
#: Words of texts looked at together.
_TOGETHER = 300_000


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _word(token: bytes) -> bytes:
    return b"\0" + (token.strip(_EDGES) or token) + b"\0"


def keys_of(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte but the first of each word: it and the `order` bytes before it as one number, how many of
    those belong to the word, and the number of the word."""
    data = np.frombuffer(b"\0" * order + b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    place = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    key = np.zeros(len(word), np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | data[j : j + len(key)]
    real = place > 0
    return key[real], place[real], word[real]


def _cut(key: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes of each key."""
    return key & np.uint64((1 << (8 * size)) - 1)


def _discount(n: np.ndarray) -> float:
    once, twice = (n == 1).sum(), (n == 2).sum()
    return float(once / (once + 2 * twice)) if once else 0.5


@dataclass
class Level:
    """Counts of one context length: grams (context and byte), their counts, the context of each; of contexts their
    totals and backoff weights. Rows of counts: ordinary, toxic, both."""

    gram: np.ndarray
    n: np.ndarray
    context_of: np.ndarray
    total: np.ndarray
    backoff: np.ndarray
    discount: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, counts: np.ndarray) -> Level:
        n = np.vstack([counts, counts.sum(axis=0)]).astype(float)
        context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
        sums = lambda x: np.stack([np.bincount(at, weights=v, minlength=len(context)) for v in x])
        discount = np.array([_discount(v) for v in n])
        lost = np.minimum(n, discount[:, None])
        small = np.float32  # goes to every worker
        return cls(gram, n.astype(small), at.astype(np.int32), sums(n).astype(small), sums(lost).astype(small), discount.astype(small))

    def step(self, key: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities (ordinary, toxic, both) of the keys' last bytes, from those with a context shorter by one.

        A byte that neither class has after the context keeps the shorter context's: the weight of that backoff
        comes from the shared counts and cancels where the classes are compared.
        """
        ask, back = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(self.gram, ask), len(self.gram) - 1)
        hit = (self.gram[at] == ask)[back]
        at = at[back][hit]
        c = self.context_of[at]
        seen, total, backoff, low = np.maximum(self.n[:, at] - self.discount[:, None], 0), self.total[:, c], self.backoff[:, c], p[:, hit]
        both = (seen[2] + backoff[2] * low[2]) / total[2]
        mine = np.where(total[:2] > 0, (seen[:2] + backoff[:2] * both) / np.maximum(total[:2], 1), low[:2])
        out = p.copy()
        out[:, hit] = np.vstack([mine, both])
        return out


def levels_of(words: list[bytes], counts: np.ndarray, order: int) -> list[Level]:
    """Kneser-Ney counts of words (as _word writes them) found in counts[class] documents."""
    key, place, word = keys_of(words, order)
    out, longer = [], None
    for k in range(order, -1, -1):
        here = place >= k if k == order else place == k
        gram, n = _cut(key[here], k + 1), counts[:, word[here]]
        if longer is not None:  # one for each different byte before it
            gram = np.concatenate([gram, _cut(longer.gram, k + 1)])
            n = np.concatenate([n, longer.n[:2] > 0], axis=1)
        gram, at = np.unique(gram, return_inverse=True)
        longer = Level.of(gram, np.stack([np.bincount(at, weights=v, minlength=len(gram)) for v in n]))
        out.append(longer)
    return out[::-1]


@dataclass
class Model:
    levels: list[Level]
    order: int
    curve: tuple[float, ...] = PRIOR
    known: dict[bytes, float] = field(default_factory=dict)

    def probabilities(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ordinary, toxic, both) of each byte of the words, and the number of its word."""
        key, place, word = keys_of(words, self.order)
        p = np.full((3, len(key)), 1 / 256)
        for k, level in enumerate(self.levels):
            here = place >= k
            if len(level.gram) and here.any():
                p[:, here] = level.step(_cut(key[here], k + 1), p[:, here])
        return p, word

    def learn(self, tokens: Iterable[bytes]) -> None:
        """Works out the log-likelihood ratios of tokens not met before."""
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = list(set(tokens) - self.known.keys())
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            p, word = self.probabilities([_word(t) for t in some])
            ratio = np.bincount(word, weights=np.log(p[1]) - np.log(p[0]), minlength=len(some))
            self.known.update(zip(some, ratio.tolist()))

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """A row for each text. Words are worked out together for texts of some megabytes."""
        out, waiting, size = [], [], 0

        def done() -> None:
            self.learn(chain.from_iterable(waiting))
            for tokens in waiting:
                llr = np.fromiter(map(self.known.__getitem__, tokens), float, len(tokens))
                out.append([np.clip(llr - least, 0, most).sum() / (len(tokens) + PAD) for least, most in EXCESS])
            waiting.clear()

        for text in texts:
            waiting.append(_tokens(text))
            size += len(waiting[-1])
            if size > _TOGETHER:
                done()
                size = 0
        done()
        return np.sqrt(np.array(out).reshape(-1, len(EXCESS)))

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        z = self.features(texts) @ np.array(self.curve[:-1]) + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words, and in how many of the batches' texts of either class each is."""
    counts: Counter[tuple[bytes, int]] = Counter()

    def out() -> Iterator[pd.DataFrame]:
        rows = list(counts.items())
        counts.clear()
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pd.DataFrame({"w": [w for (w, _), _ in part], "o": [n * (1 - k) for (_, k), n in part], "t": [n * k for (_, k), n in part]})

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts.update((w, int(toxic)) for w in set(map(_word, _tokens(text))))
            if len(counts) > 500_000:
                yield from out()
    yield from out()


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, toxic): per_class rows at most of either class, equal texts once. labels: (id, toxic)."""
    parts = [labels.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(texts.join(parts[0].unionAll(parts[1]), "id").dropDuplicates(["text", "toxic"]), "sample")


def fit(docs: DataFrame, labels: DataFrame, held_out, fold, per_class: int = 3000, order: int = 6, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The models and the curve. held_out and fold make conditions of the id column: rows whose labels are never
    looked at, and rows of the sample that fit the curve instead of the models.

    The words of the sample and their counts (bounded by per_class) pass through the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    sample = labelled_sample(docs, known, per_class, id_col, text_col)
    learn, calibrate = sample.where(~fold(F.col("id"))), sample.where(fold(F.col("id")))
    words = learn.select("text", "toxic").mapInPandas(_words, "w binary, o long, t long").groupBy("w").agg(F.sum("o").alias("o"), F.sum("t").alias("t")).toArrow()
    model = Model(levels_of(words["w"].to_pylist(), np.stack([words[c].to_numpy() for c in "ot"]), order), order)
    model.curve = _curve(model, calibrate, {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()})
    return model


def _curve(model: Model, calibrate: DataFrame, rows: dict[int, int]) -> tuple[float, ...]:
    """Logistic curve over the features of labelled texts, each class weighing as in the labels."""
    at = calibrate.sparkSession.sparkContext.broadcast(model)
    names = [f"x{i}" for i in range(len(EXCESS))]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(at.value.features(b["text"]), columns=names).assign(toxic=b["toxic"].to_numpy())

    seen = calibrate.select("text", "toxic").mapInPandas(features, ", ".join(f"{c} double" for c in names) + ", toxic int").orderBy(*names, "toxic").toPandas()
    if seen["toxic"].nunique() < 2:
        return PRIOR
    z, t = np.column_stack([seen[names].to_numpy(), np.ones(len(seen))]), seen["toxic"].to_numpy(float)
    n = [max(1, (t == k).sum()) for k in (0, 1)]
    weight = np.where(t == 1, rows.get(1, 1) / n[1], rows.get(0, 1) / n[0])
    weight /= weight.mean()
    scale = np.maximum(np.abs(z).max(axis=0), 1e-9)
    z, b = z / scale, np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (t - p)) - 1e-2 * b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b)), g)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(x) for x in b / scale)


def score_column(model: Model, text: str | Column, spark) -> Column:
    """Score of each text, 0 to 1; the model goes to the executors once."""
    at = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(at.value.score(texts))

    return of(text)


def held_out_id(id_col: Column) -> Column:
    return crc32_of_id(id_col) % 4 == 2


def _fold(id_col: Column) -> Column:
    return crc32_of_id(id_col) % 4 == 3


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """docs with columns held_out, score and predicted (columns of docs of those names are replaced).

    Rows whose crc32 of the id mod 4 is 2 are held out: their labels are never looked at, neither by the models nor
    for the share of either class. Of the others, those with remainder 3 fit the curve, the rest the models. A null label is
    no label; several labels of an id count as their greatest. Null and empty texts get the score of a text
    without evidence. Texts of any length are scored whole. Without labels of both
    classes the score follows a fixed curve. Repeated rows get equal scores. An empty table gives an empty result.
    """
    model = fit(docs, labels, held_out_id, _fold, id_col=id_col, text_col=text_col, label_col=label_col, **how)
    scored = docs.withColumn("held_out", held_out_id(F.col(id_col))).withColumn("score", score_column(model, F.col(text_col), docs.sparkSession))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def not_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """The rows of docs that score() doesn't predict to be toxic, with the columns of docs, whatever their names."""
    model = fit(docs, labels, held_out_id, _fold, id_col=id_col, text_col=text_col, label_col=label_col, **how)
    return docs.where(score_column(model, F.col(text_col), docs.sparkSession) < threshold)
