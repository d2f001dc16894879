"""Alignment of two tokenizers over the same texts, by an event sweep.

Every token gives one event, its end offset in bytes. The events of both tokenizers, packed in blocks of a text, are
united, repartitioned by document and sorted by offset; a machine with constant state then sweeps over the offsets. Where
events of both sides meet, a group closes. Each distinct offset gives one link: the stretch before it lies in exactly
one A token and one B token, and no other offset falls between two tokens that overlap.

A is a byte-level BPE of the tokenizers library, B a BPE of sentencepiece. Both cut a text wherever a single space stands
between two characters that aren't white space, so such stretches are encoded once per worker and remembered. This
is checked when the files are read: no piece of B may hold a space after another character, and A must split by the
byte-level pattern.

Null and empty texts, and texts that a tokenizer doesn't give back byte by byte (those with U+2581), have no tokens.
Every row counts, repeated ids and rows included; a null id stays null; columns besides id and text aren't looked at.
A text of any length is one row and at most as many events as bytes; events and links go through tasks in blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.common import written
from tablescribe.llm.tokens import _AS_CHARACTER

#: A single space between characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Stretches remembered by a worker; beyond that it starts anew.
_REMEMBERED = 400_000
#: Characters of a text in one block of events.
_BLOCK = 1 << 16
#: Pairs of ids up to which every worker holds their counts (13 bytes each); beyond that links are joined to the counts.
MOST_HELD = 1 << 23


class Stretches(dict):
    """For each stretch of text after a space (without it): its A ids and its B ids as bytes; False if a tokenizer changes
    it, None if it has to be cut differently because white space stands at its ends."""

    def __init__(self, a_path: str, b_path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.a.model
        as_byte = {c: b for b, c in _AS_CHARACTER.items()}
        vocabulary = sorted(self.a.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        self.a_bytes = {i: bytes(map(as_byte.__getitem__, t)) for t, i in vocabulary if all(c in as_byte for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b_path}: pieces hold spaces after other characters, so texts can't be cut at spaces")
        step = self.a.pre_tokenizer
        if type(step).__name__ != "ByteLevel" or step.add_prefix_space or self.a.normalizer is not None:
            raise ValueError(f"{a_path}: not a plain byte-level tokenizer")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_a, self.n_b = max(self.a_bytes) + 1, len(pieces)
        self.kinds = ["H" if n <= 1 << 16 else "I" for n in (self.n_a, self.n_b)]

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each id, of A and of B."""
        return np.array([len(self.a_bytes.get(i, b"")) for i in range(self.n_a)]), np.array([len(x) for x in self.b_bytes])

    def _a_ids(self, rest: str) -> list[int]:
        word, end = (rest[:-1], rest[-1]) if rest[-1:] in (".", ",") else (rest, "")
        if not word.isalpha() or max(word) > "\u052f":  # letters are one piece to A's splitter: its BPE model is asked directly
            return self.a.encode(" " + rest, add_special_tokens=False).ids
        ids = [t.id for t in self.model.tokenize("".join(map(_AS_CHARACTER.__getitem__, (" " + word).encode())))]
        return ids + [t.id for t in self.model.tokenize(end)] if end else ids

    def encoded(self, rest: str) -> tuple[bytes, bytes] | bool:
        """The ids of a space and rest."""
        a, b, text = self._a_ids(rest), self.b.encode(rest), (" " + rest).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != text or b"".join(map(self.b_bytes.__getitem__, b)) != text:
            return False
        return array(self.kinds[0], a).tobytes(), array(self.kinds[1], b).tobytes()

    def __missing__(self, rest: str) -> tuple[bytes, bytes] | bool | None:
        found = None if not rest or rest[0].isspace() or rest[-1].isspace() else self.encoded(rest)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[rest] = found
        return found

    def of(self, text: str) -> list[tuple[bytes, bytes]]:
        """The ids of a space and the text, stretch by stretch; none if a tokenizer changes the text."""
        found = list(map(self.__getitem__, text.split(" ")))
        if None in found:
            first, *others = _CUT.split(" " + text)
            found = [self.encoded(first[1:]), *(self.encoded(x) if self[x] is None else self[x] for x in others)]
        return [] if False in found else found


@lru_cache(maxsize=1)
def stretches(a_path: str, b_path: str) -> Stretches:
    return Stretches(a_path, b_path)


def events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The end events of both sides' tokens in blocks: doc (a number of the row), doc_id, start (of the block, in stretches of the
    text), side (0: A, 1: B), ids. A block's ids give its offsets: their bytes follow one another. docs: doc_id, text.
    A text without tokens has one empty block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = stretches(a_path, b_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                found, at = known.of(text) if text else [], at + 1
                if not found:
                    rows.append((at, k, 0, 0, b""))
                step = max(1, len(found) * _BLOCK // max(_BLOCK, len(text or "")))
                for start in range(0, len(found), step):
                    a, b = zip(*found[start : start + step])
                    rows += [(at, k, start, 0, b"".join(a)), (at, k, start, 1, b"".join(b))]
                    size += len(rows[-1][-1]) + len(rows[-2][-1])
                if size > 1 << 22:
                    yield packed(rows, batch.column(0))
                    rows, size = [], 0
            if rows:
                yield packed(rows, batch.column(0))

    def packed(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
        doc, k, start, side, data = zip(*rows)
        return pa.record_batch({"doc": pa.array(doc, pa.int64()), "doc_id": ids.take(pa.array(k, pa.int64())), "start": pa.array(start, pa.int64()), "side": pa.array(side, pa.int8()), "ids": pa.array(data, pa.binary())})

    return docs.mapInArrow(read, f"doc long, doc_id {kind}, start long, side byte, ids binary")


class Sweep:
    """Goes over the events of documents, block after block, and gives a row per document when it is complete."""

    def __init__(self, known: Stretches) -> None:
        self.types = [np.dtype("<u2" if k == "H" else "<u4") for k in known.kinds]
        self.lengths, self.n_b = known.lengths(), known.n_b
        self.code = code_type(known)
        texts = [[f"{i}{end}".encode() for end in ends for i in range(n)] for n, ends in ((known.n_a, ",|"), (known.n_b, ",;"))]
        width = max(map(len, texts[0] + texts[1]))
        self.texts = [np.array(t, f"S{width}") for t in texts]
        self.sizes = [known.n_a, known.n_b]
        self.now: tuple | None = None  # the document under way: doc, doc_id, four counts, hash, code and count arrays

    def blocks(self, docs: list[tuple], a: bytes, b: bytes) -> Iterator[tuple]:
        """docs: (doc, doc_id, bytes of A ids, bytes of B ids) in order; a, b: all their ids."""
        ids = [np.frombuffer(x, t) for x, t in zip((a, b), self.types)]
        ends = [np.cumsum(length[i]) for i, length in zip(ids, self.lengths)]
        total = int(ends[0][-1]) if len(ends[0]) else 0
        mark = np.zeros(total + 1, np.uint8)
        mark[ends[0]] = 1
        mark[ends[1]] |= 2
        at = np.flatnonzero(mark)  # the distinct offsets in order
        seen = mark[at]
        is_a, is_b = seen & 1, seen >> 1
        to_a, to_b, both = np.cumsum(is_a, dtype=np.int64), np.cumsum(is_b, dtype=np.int64), is_a & is_b
        groups = np.cumsum(both, dtype=np.int64)
        links = ids[0][to_a - is_a].astype(np.int64) * self.n_b + ids[1][to_b - is_b]
        # the text of the groups: tokens of A and of B in the order of their groups, each followed by its mark
        last_a, last_b = to_a[both == 1], to_b[both == 1]
        place_a, place_b = np.arange(len(ids[0])), np.arange(len(ids[1]))
        of_a, of_b = np.searchsorted(last_a, place_a, "right"), np.searchsorted(last_b, place_b, "right")
        closes_a, closes_b = np.zeros(len(place_a), bool), np.zeros(len(place_b), bool)
        closes_a[last_a - 1], closes_b[last_b - 1] = True, True
        out = np.empty(len(place_a) + len(place_b), self.texts[0].dtype)
        out[place_a + np.concatenate([[0], last_b])[of_a]] = self.texts[0][ids[0] + self.sizes[0] * closes_a]
        out[place_b + last_a[of_b] if len(last_a) else place_b] = self.texts[1][ids[1] + self.sizes[1] * closes_b]

        sizes = np.array([[len(x[2]) // self.types[0].itemsize, len(x[3]) // self.types[1].itemsize] for x in docs], np.int64).reshape(-1, 2)
        upto = np.cumsum(sizes, axis=0)
        end_at = np.where(upto[:, 0] > 0, ends[0][upto[:, 0] - 1], 0) if len(ends[0]) else np.zeros(len(docs), np.int64)
        n_links = np.searchsorted(at, end_at, "right")
        n_groups = np.concatenate([[0], groups])[n_links]
        codes, times, upto_code = self._by_doc(links, np.diff(np.concatenate([[0], n_links])))
        last = np.zeros(5, np.int64)
        for k, (doc, doc_id, _, _) in enumerate(docs):
            here = np.array([*upto[k], n_groups[k], n_links[k], upto_code[k]])
            if self.now and self.now[0] != doc:
                yield self.done()
            if not self.now:
                self.now = (doc, doc_id, np.zeros(4, np.int64), hashlib.sha256(), [], [])
            text = out[last[0] + last[1] : here[0] + here[1]].tobytes().translate(None, b"\0")
            if text and self.now[2][0]:
                text = b";" + text
            self.now[3].update(text[:-1])
            self.now[2][:] += (here - last)[:4]
            self.now[4].append(codes[last[4] : here[4]])
            self.now[5].append(times[last[4] : here[4]])
            last = here

    def _by_doc(self, links: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct links of each document and how often it has them, as bytes: over 255 times takes several entries."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((links, doc)) if self.code.itemsize > 4 else None
        if order is None:
            both = np.sort(doc << 32 | links)
            new = np.flatnonzero(np.diff(both, prepend=-1))
            doc, links = both[new] >> 32, both[new] & 0xFFFFFFFF
            n = np.diff(np.append(new, len(both)))
        else:
            doc, links = doc[order], links[order]
            new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(links, prepend=-1))
            n = np.diff(np.append(new, len(doc)))
            doc, links = doc[new], links[new]
        if len(n) and n.max() > 255:
            parts = -(-n // 255)
            first = np.repeat(np.cumsum(parts) - parts, parts)
            doc, links, n = np.repeat(doc, parts), np.repeat(links, parts), np.minimum(255, np.repeat(n, parts) - 255 * (np.arange(len(first)) - first))
        return links.astype(self.code), n.astype(np.uint8), np.searchsorted(doc, np.arange(len(sizes)), "right")

    def done(self) -> tuple:
        doc, doc_id, counts, digest, codes, times = self.now
        self.now = None
        return (doc_id, *map(int, counts), digest.hexdigest() if counts[0] else "", b"".join(x.tobytes() for x in codes), b"".join(x.tobytes() for x in times))


def code_type(known: Stretches) -> np.dtype:
    """Of a pair of ids: a * (number of B ids) + b."""
    return np.dtype("<u4" if known.n_a * known.n_b <= 1 << 32 else "<u8")


_COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")


def swept(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document: n_a, n_b, n_groups, n_links, groups_sha256, and its links: distinct pairs (codes) and how often it has them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(stretches(a_path, b_path))
        rows: list[tuple] = []
        waiting: list[tuple] = []  # documents' blocks whose two sides have come
        half, size = None, 0

        def table() -> pa.RecordBatch:
            types = (batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_COLUMNS)

        for batch in batches:
            for doc, doc_id, side, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if side == 0 and ids:
                    half = ids
                    continue
                waiting.append((doc, doc_id, half or b"", ids))
                half, size = None, size + len(ids)
                if size > 1 << 20:
                    rows += machine.blocks(waiting, b"".join(x[2] for x in waiting), b"".join(x[3] for x in waiting))
                    waiting, size = [], 0
                    if rows:
                        yield table()
                    rows.clear()
        rows += machine.blocks(waiting, b"".join(x[2] for x in waiting), b"".join(x[3] for x in waiting))
        if machine.now:
            rows.append(machine.done())
        if rows:
            yield table()

    sorted_events = events(docs, a_path, b_path).repartition("doc").sortWithinPartitions("doc", "start", "side")
    return sorted_events.mapInArrow(sweep, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary")


def pair_counts(links: DataFrame, code: np.dtype, n_b: int) -> tuple[DataFrame, int]:
    """How many links hold each pair: code, n, best (no pair with its B id has more); and the number of pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.empty(0, np.int64), np.empty(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            c, n = np.concatenate([codes, *(x[0] for x in new)]), np.concatenate([times, *(x[1] for x in new)])
            order = np.argsort(c, kind="stable")
            c, n = c[order], n[order]
            first = np.flatnonzero(np.diff(c, prepend=-1))
            return c[first], np.add.reduceat(n, first) if len(first) else n

        for batch in batches:
            new.append((_flat(batch.column(0), code).astype(np.int64), _flat(batch.column(1), np.dtype("u1")).astype(np.int64)))
            size += len(new[-1][0])
            if size > 1 << 21:
                (codes, times), new, size = merged(), [], 0
                if len(codes) > 1 << 22:  # memory stays bounded: Spark adds up what a task gives in parts
                    yield pa.record_batch({"code": codes, "n": times})
                    codes, times = codes[:0], times[:0]
        codes, times = merged()
        for k in range(0, len(codes), 1 << 16):
            yield pa.record_batch({"code": codes[k : k + (1 << 16)], "n": times[k : k + (1 << 16)]})

    counted = links.select("codes", "times").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("b", F.col("code") % n_b), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    best = counted.join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))  # most: a row for each B id at most
    return best, counted.count()


def _flat(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """The numbers in a column of binaries, one after another."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, kind)
    ends = np.frombuffer(offsets, np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def align(docs: DataFrame, a_path: str, b_path: str, most_held: int = MOST_HELD) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: its links whose pair no other pair with the same B id outnumbers in all documents; count_sum: over its links, how many
    links of all documents hold their pair. With up to most_held distinct pairs, workers hold their counts; with more,
    the documents' links are joined to them.
    """
    known = stretches(a_path, b_path)
    code, n_b = code_type(known), known.n_b
    links = written(swept(docs.select("doc_id", "text"), a_path, b_path), "links")
    counts, pairs = pair_counts(links, code, n_b)
    digests = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if pairs > most_held:
        return _joined(links, counts, code).select(*digests, "n_best", "count_sum", "groups_sha256")
    held = counts.toPandas().sort_values("code")
    shared = links.sparkSession.sparkContext.broadcast((held["code"].to_numpy().astype(code), held["n"].to_numpy(np.int64), held["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for batch in batches:
            own, times = _flat(batch.column(6), code), _flat(batch.column(7), np.dtype("u1")).astype(np.int64)
            at = np.searchsorted(codes, own)
            sums = [np.concatenate([[0], np.cumsum(times * x)]) for x in (best[at], n[at])]
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(7)).to_numpy())])
            n_best, count_sum = (np.diff(s[ends]) for s in sums)
            yield pa.record_batch([*batch.columns[:5], pa.array(n_best), pa.array(count_sum), batch.column(5)], names=[*digests, "n_best", "count_sum", "groups_sha256"])

    kind = dict(links.dtypes)["doc_id"]
    return links.mapInArrow(look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _joined(links: DataFrame, counts: DataFrame, code: np.dtype) -> DataFrame:
    """links with n_best and count_sum by a join of their pairs to the counts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            for k in range(0, len(row), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.record_batch({"row": batch.column(0).take(pa.array(row[part])), "code": _flat(batch.column(1), code)[part].astype(np.int64), "times": _flat(batch.column(2), np.dtype("u1"))[part].astype(np.int64)})

    numbered = written(links.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spread_out = numbered.select("row", "codes", "times").mapInArrow(spread, "row long, code long, times long")
    sums = spread_out.join(counts, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return numbered.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
