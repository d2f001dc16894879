import hashlib
import random
from collections import Counter

import pytest

from tablescribe.llm import repeats


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, length):
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lo long, blob string"), length).collect()
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def test_documents(spark, docs, texts, nothing):
    for length in (400, 64):
        got = repeats.remove_repeats(docs, length).collect()
        assert sorted(slow([t for _, t in texts], length)) == sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert sum(r["n_removed"] for r in got) > 0
    for r in got:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh", "aé"])
def test_few_letters_and_shared_passages(spark, alphabet):
    r = random.Random(alphabet)
    some = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [some(r.randint(20, 90)) for _ in range(4)]
    rows = [(i % 9, some(r.randint(0, 60)) + r.choice(passages) + some(r.randint(0, 40)) + r.choice(passages)[: r.randint(1, 90)], 1, "x") for i in range(30)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1, None), (None, None, None, None)]
    for length in (16, 33):
        assert run(spark, rows, length) == sorted(slow([x[1] for x in rows], length))


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    r = random.Random(1)
    a = "".join(r.choice("abcdefghij ") for _ in range(1_200_000))
    rows = [(1, a, 1, ""), (2, "zz" + a[600_000:900_000] + "zz", 1, "")]
    n, removed, spans, _ = run(spark, rows, 400)[1]
    assert (n, removed, spans) == (1_200_000, 300_000, 1)
