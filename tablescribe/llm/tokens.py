"""Token ids with a public tokenizer of the tokenizers library, and a binary file format for them.

The file format is the Arrow IPC file format (record batches with a footer for random access). A shard
holds the ids of its documents one after another, cut into sequences of equal length: column `ids`, a
fixed-size list of unsigned integers (16 bits where the vocabulary allows), and column `mask`, a
fixed-size list of bytes, 1 for ids and 0 on the padding that ends the shard. Both are flat buffers, so sequence k
of a memory-mapped shard is a slice without copying. Beside each shard lies its index, in the same
format: document, first id in the shard, number of ids.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescribe.llm.common import shared_folder

#: How byte-level tokenizers write each byte as a character: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTER = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}

#: The split of tokenizers whose texts can be encoded word by word: contractions, letters, single digits, all other characters.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer's file says that the ids of a text are those of its lower-cased words in turn."""
    steps = lambda part, key: [] if not part else part[key] if part["type"] == "Sequence" else [part]
    normal, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    spaces = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in normal)
    split = len(pre) == 2 and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": _SPLIT} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    return spaces and split and any(x["type"] == "Lowercase" for x in normal) and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1].get("use_regex", True)


#: Words remembered by a worker; beyond that it starts anew, so memory stays bounded.
_REMEMBERED = 900_000


class WordIds(dict):
    """The ids of words between ASCII white space, as little-endian bytes, remembered.

    For tokenizers that drop white space, so that the ids of a text are those of its words in turn, and that
    lower the case, so that a word may be looked up in lower case; with any other, texts are encoded whole. A full stop or comma at the end of a
    word ending in a letter is a piece of its own; this saves encoding most words twice.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.short_way = by_words(json.loads(self.tokenizer.to_str()))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encoded(self, word: bytes) -> bytes:
        return array("I" if self.wide else "H", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _piece(self, word: bytes) -> bytes:
        """The ids of a word that is one piece to the tokenizer and that its normalizer leaves as it is: only
        lower-case letters of the Latin alphabet up to U+017F. Its BPE model is asked directly."""
        return array("I" if self.wide else "H", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_AS_CHARACTER))]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 2 and word[-1:] in b".," and 97 <= word[-2] <= 122:
            ids = self[word[:-1]] + self[word[-1:]]
        elif word.isalpha() or (text := word.decode()).isalpha() and max(text) < "\u0180" and text == text.lower():
            ids = self._piece(word)
        else:
            ids = self._encoded(word)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not self.short_way:
            return array("I" if self.wide else "H", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()
        data = (text or "").encode()
        low = data.lower()
        if any(s in low for s in self.special):  # a special token counts only as written
            return b"".join(map(self._encoded, data.split()))
        return b"".join(map(self.__getitem__, low.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False))


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _list_type(kind: pa.DataType, length: int) -> pa.DataType:
    return pa.list_(pa.field("item", kind, nullable=False), length)


class ShardWriter:
    """Writes ids as sequences of equal length; the last one is padded with zeros and masked."""

    def __init__(self, sink, kind: np.dtype, length: int, batch: int = 256) -> None:
        self.length, self.batch, self.kind = length, batch, kind
        self.schema = pa.schema([pa.field("ids", _list_type(pa.from_numpy_dtype(kind), length), nullable=False), pa.field("mask", _list_type(pa.uint8(), length), nullable=False)])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting, self.n = bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.waiting += ids
        self.n += len(ids) // self.kind.itemsize
        size = self.batch * self.length * self.kind.itemsize
        if len(self.waiting) >= size:
            whole = len(self.waiting) - len(self.waiting) % size
            data = np.frombuffer(bytes(self.waiting[:whole]), self.kind)
            for i in range(0, len(data), self.batch * self.length):
                self._write(data[i : i + self.batch * self.length], self.batch * self.length)
            del self.waiting[:whole]

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = (np.arange(len(ids)) < real).astype(np.uint8)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            rest = np.frombuffer(bytes(self.waiting), self.kind)
            size = -(-len(rest) // self.length) * self.length
            self._write(np.concatenate([rest, np.zeros(size - len(rest), self.kind)]), len(rest))
        self.writer.close()


class Shard:
    """A shard opened for reading: ids and masks by sequence or by range, without copying within a batch."""

    def __init__(self, path: str) -> None:
        fs, at = _filesystem(path)
        self.file = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.reader = pa.ipc.open_file(self.file)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def _batch(self, k: int) -> pa.RecordBatch:
        if k not in self.batches:
            self.batches = {k: self.reader.get_batch(k)}
        return self.batches[k]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence k, both views of the file's buffers."""
        b, row = self._batch(k // self.batch), k % self.batch
        part = slice(row * self.length, (row + 1) * self.length)
        return b.column("ids").flatten().to_numpy(zero_copy_only=True)[part], b.column("mask").flatten().to_numpy(zero_copy_only=True)[part].view(bool)

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids start .. start + n - 1 of the shard: a view if they lie in one batch."""
        size, parts = self.batch * self.length, []
        while n > 0:
            flat = self._batch(start // size).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = flat[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def close(self) -> None:
        self.batches.clear()
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Tokenizes the texts and writes them to shards in ascending id order (null first), end_id after each.

    Returns a row per shard: shard, path, index (its path), docs, n_ids; `folder` defaults to a new one in the
    shared folder. Documents are range-partitioned by id, each partition writes one shard under a name
    of its own attempt and then gives it its final name, so a task that is run again does no harm. Null texts are
    empty and still get end_id. Rows that repeat an id stand next to each other. An empty table gives no shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shards"
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)[id_col]
    h = F.xxhash64(text_col)
    sorted_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h.alias("h")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, ids_of = TaskContext.get(), word_ids(tokenizer)
        end = np.array([end_id], ids_of.type).tobytes()
        fs, base = _filesystem(folder)
        name = f"{base}/part-{context.partitionId():06d}"
        mine = f"{base}/.attempt-{context.taskAttemptId()}"
        writer, doc_ids, counts = None, [], []
        for b in batches:
            for doc, text in zip(b["id"], b["text"]):
                if writer is None:
                    fs.create_dir(base)
                    sink = fs.open_output_stream(f"{mine}.arrow")
                    writer = ShardWriter(sink, ids_of.type, length)
                ids = ids_of.of(text) + end
                writer.add(ids)
                doc_ids.append(doc)
                counts.append(len(ids) // ids_of.type.itemsize)
        if writer is None:
            return
        total = writer.n
        writer.close()
        sink.close()
        counts = np.array(counts, np.int64)
        index = pa.table({"doc": pa.array(doc_ids, _arrow_type(kind), from_pandas=True), "start": np.cumsum(counts) - counts, "n": counts})
        with fs.open_output_stream(f"{mine}.index") as out, pa.ipc.new_file(out, index.schema) as f:
            f.write_table(index)
        for end_of_name in ("arrow", "index"):
            fs.move(f"{mine}.{end_of_name}", f"{name}.{end_of_name}")
        full = f"{folder}/part-{context.partitionId():06d}"
        yield pd.DataFrame({"shard": [context.partitionId()], "path": [f"{full}.arrow"], "index": [f"{full}.index"], "docs": [len(counts)], "n_ids": [total]})

    return sorted_docs.mapInPandas(write, "shard long, path string, index string, docs long, n_ids long")


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())


def read_documents(spark, shards: list, id_type: str = "bigint") -> DataFrame:
    """The documents of the shards (rows of write_shards, in order): doc, start, n_tokens, ids_crc32."""
    before, rows = 0, []
    for s in sorted(shards, key=lambda s: s["shard"]):
        rows.append((s["path"], s["index"], before))
        before += s["n_ids"]
    listed = spark.createDataFrame(rows, "path string, index string, before long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, index, first in zip(b["path"], b["index"], b["before"]):
                fs, at = _filesystem(index)
                with fs.open_input_file(at) as f:
                    docs = pa.ipc.open_file(f).read_all()
                shard = Shard(path)
                for part in docs.to_batches(max_chunksize=20_000):
                    start, n = part.column("start").to_numpy(), part.column("n").to_numpy()
                    crc = [crc32_of(shard.ids(s, k)) for s, k in zip(start, n)]
                    yield pd.DataFrame({"doc": part.column("doc").to_pandas(types_mapper=pd.ArrowDtype), "start": start + first, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)})
                shard.close()

    return listed.mapInPandas(read, f"doc {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", length: int = 2048) -> DataFrame:
    """Writes the shards, reads them back, and returns per document: id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it in the whole set. The list of shards, one row per file,
    goes through the driver; ids and documents don't.
    """
    kind = dict(docs.dtypes)[id_col]
    shards = write_shards(docs, tokenizer, end_id, length=length, id_col=id_col, text_col=text_col).collect()
    return read_documents(docs.sparkSession, shards, kind).withColumnRenamed("doc", id_col)
