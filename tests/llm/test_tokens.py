import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablescribe.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)


def real(text):
    return np.array(REAL.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("abAB.,'!9 \n\t\x0b\x1c  éÉ́ſİΣσ<|>世界😀") + ["it's.", "<|endoftext|>", "<|ENDOFTEXT|>", "they're,"]), max_size=40).map("".join))
def test_word_ids_equal_the_tokenizer(text):
    assert np.frombuffer(tokens.word_ids(PATH).of(text), "<u2").tolist() == real(text).tolist()


def expected(texts, end):
    rows = sorted(((i is not None, i if i is not None else 0, np.append(real(t), [end]).astype("<u4")) for i, t in texts), key=lambda r: r[:2])
    return rows


def test_round_trip(docs, nothing, texts):
    got = sorted(tokens.round_trip(docs, PATH, length=64).collect(), key=lambda r: r["start"])
    want = expected(texts, 2)
    at = 0
    assert [r["doc_id"] for r in got] == [i if some else None for some, i, _ in want]
    crcs = {}
    for some, i, ids in want:
        crcs.setdefault((some, i), set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in crcs[(r["doc_id"] is not None, r["doc_id"] or 0)]
        at += r["n_tokens"]
    assert at == sum(len(ids) for *_, ids in want)
    assert tokens.round_trip(nothing, PATH).count() == 0


def test_sequences_and_masks_are_random_access(docs, texts):
    shard = tokens.write_shards(docs, PATH, 2, length=32, shards=1).collect()
    assert len(shard) == 1
    s = tokens.Shard(shard[0]["path"])
    n = shard[0]["n_ids"]
    flat = np.concatenate([s.sequence(k)[0] for k in range(-(-n // 32))])
    mask = np.concatenate([s.sequence(k)[1] for k in range(-(-n // 32))])
    assert mask.sum() == n and mask[:n].all() and not flat[n:].any()
    assert (s.ids(0, n) == flat[:n]).all() and sorted(flat[:n].tolist()) == sorted(x for *_, ids in expected(texts, 2) for x in ids.tolist())
    assert not s.sequence(1)[0].flags.owndata  # a view of the mapped file
    s.close()


@pytest.mark.parametrize("window", [16, 256])
@pytest.mark.parametrize("tasks", [1, 4])
def test_packing_covers_every_id_once(docs, texts, window, tasks):
    docs = docs.coalesce(tasks)
    got = packing.pack(docs, PATH, end_id=1, window=window, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    short = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        short += at < window
    assert short <= docs.rdd.getNumPartitions() <= tasks  # one sequence of each block is padded
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for i, t in {(i, t) for i, t in texts}:
        ids = np.append(real(t), [1]).astype("<u4")
        same = [ids.tobytes() for j, u in texts if (j, u) == (i, t)]
        starts = sorted(pieces[(i, len(ids))])
        assert all(ids[s : s + len(x) // 4].tobytes() == x for s, x in starts)
        assert sum(len(x) for _, x in starts) == sum(map(len, same))


def test_packing_nothing(nothing):
    assert packing.pack(nothing, PATH).count() == 0


def test_least_squares_uses_up_a_histogram_made_of_combinations():
    columns = packing.combinations(64)
    assert (columns.sum(axis=1) == 64).all()
    target = np.zeros(64)
    for row, n in ((5, 100), (40, 30), (80, 7)):
        for v in columns[row][columns[row] > 0]:
            target[v] += n
    x = packing.nnls(columns, target)
    made = np.zeros(64)
    for row, n in zip(columns, x):
        for v in row[row > 0]:
            made[v] += n
    assert (x >= 0).all() and np.abs(made - target).max() < 1
    lengths = np.repeat(np.arange(64), target.astype(int))
    np.random.default_rng(3).shuffle(lengths)
    sequence, offset, used = packing.place(lengths, 64)
    assert used == -(-lengths.sum() // 64) and (offset + lengths <= 64).mean() >= 0.9
    taken = np.zeros(64 * (used + 1), int)
    for s, o, n in zip(sequence, offset, lengths):
        taken[64 * s + o : 64 * s + o + n] += 1
    assert taken.max() == 1 and taken.sum() == lengths.sum()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    text = "Two  Words, it's 42.\n\tNaïve <|endoftext|> ÀB"
    folder = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
    seen = set()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json"):
            ids_of = tokens.WordIds(f"{folder}/{name}")
            seen.add(ids_of.short_way)
            ids = np.frombuffer(ids_of.of(text), ids_of.type).tolist()
            assert ids == Tokenizer.from_file(f"{folder}/{name}").encode(text, add_special_tokens=False).ids, name
    assert tokens.WordIds(public_tokenizers.path("word_bpe_49k.json")).short_way and True in seen


def test_ids_beside_a_null_stay_whole(spark):
    from tablescribe.llm import lines, ppm, repeats

    rows = spark.createDataFrame([(9007199254740993, "some words here"), (None, "other words"), (9007199254740995, None)], "doc_id long, text string")
    want = {9007199254740993, None, 9007199254740995}
    for df in (packing.pack(rows, PATH, end_id=1, window=64), ppm.score(rows), repeats.remove_repeats(rows), tokens.round_trip(rows, PATH)):
        assert {r["doc_id"] for r in df.select("doc_id").collect()} == want
    odd = rows.selectExpr("*", "1 AS __r", "2 AS `a.b`", "'x' AS n_words")
    judged = lines.evaluate(odd)
    assert judged.columns[:5] == odd.columns and {r["__r"] for r in judged.collect()} == {1} and judged.schema["n_words"].dataType.simpleString() == "bigint"
