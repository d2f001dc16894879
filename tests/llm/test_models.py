import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablescribe.llm import ppm, toxicity

LOW = lambda t: (t or "").encode().lower()


def slow_ppm(train, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        d = b"\xff" * order + t + b"\xff"
        for p in range(order, len(d)):
            for j in range(order + 1):
                counts[j][d[p - j : p]][d[p]] += 1

    def prob(ctx, s):
        p, out = 1.0, set()
        for j in range(order, -1, -1):
            c = {a: b for a, b in counts[j].get(ctx[order - j :], {}).items() if a not in out}
            n, d = sum(c.values()), len(c)
            if s in c:
                return p * c[s] / (n + d)
            if d:
                p *= d / (n + d)
            out |= set(c)
        return p / (256 - len(out))

    return lambda t: sum(math.log10(prob(d[p - order : p], d[p])) for d in [b"\xff" * order + t + b"\xff"] for p in range(order, len(d)))


@pytest.mark.parametrize("order", [1, 3])
def test_scores_equal_brute_force(docs, texts, order):
    small = [(i, t) for i, t in texts if len(t or "") < 1500]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [LOW(t) for i, t in small if not held(i)]
    score, words = slow_ppm(train, order), Counter(w for t in train for w in t.split())
    n, v, ends = sum(words.values()) + len(train), len(words) + 1, len(train)
    base = lambda t: sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in LOW(t).split()) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted(((i is None, i or 0), held(i), len(LOW(t).split()) + 1, sum(w in words for w in LOW(t).split()) + 1, n, base(t), score(LOW(t))) for i, t in small)
    for head, held_contexts in ((5, 1 << 18), (1 << 18, 3)):  # all contexts with the workers, or a table of its own
        got = ppm.score(docs.where("coalesce(length(text), 0) < 1500"), order=order, head=head, max_contexts=held_contexts).collect()
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_probabilities_add_up_to_one(spark, docs, nothing):
    path, _ = ppm.train(docs.select("text"), order=2)
    order = 2
    trie = ppm.load_trie(path, order)
    known = len(trie.symbol[trie.symbol < trie.size - 1])
    p = 10.0 ** trie.logs[order][:, :-1].astype(float)
    rest = 10.0 ** trie.logs[order][:, -1].astype(float) * (256 - known)
    full = p.sum(axis=1) + rest
    assert abs(full - 1).max() < 1e-4
    empty = ppm.score(nothing).collect()
    assert empty == [] and ppm.score(nothing, max_contexts=0).collect() == []
    alone = ppm.score(docs.where("doc_id = 40"), held_out=docs["doc_id"] >= 0).collect()[0]
    assert alone["train_tokens"] == 0 and alone["score"] == pytest.approx(-math.log10(256), rel=1e-5)


def labelled(words, n=600):
    r = random.Random(8)
    bad = ["vilefool", "rotscum", "gutterlout"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(30, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad)
        docs.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_texts(spark, words, nothing):
    docs, labels = labelled(words[:400])
    known = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    table = spark.createDataFrame(docs + [(900, None, 0.0), (901, "", 0.0), (902, "vilefool " * 3000, 0.0), docs[0], (None, "some words", 0.0)], "doc_id long, text string, score double")
    rows = toxicity.score(table, known).collect()
    assert len(rows) == len(docs) + 5
    by = {r["doc_id"]: r for r in rows}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i]["held_out"] == (i in held) for i, _ in labels)
    right = sum(by[i]["predicted"] == t for i, t in labels if i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert by[900]["score"] == by[901]["score"] and by[902]["predicted"] == 1 and by[900]["predicted"] == 0
    assert toxicity.score(nothing, known).count() == 0
    unlabelled = toxicity.score(table, known.where("false")).collect()
    assert len(unlabelled) == len(rows) and not any(r["predicted"] for r in unlabelled)
    assert {r["doc_id"] for r in unlabelled} == {r["doc_id"] for r in rows}


def test_held_out_labels_are_never_looked_at(spark, words):
    docs, labels = labelled(words[:400], 300)
    table = spark.createDataFrame(docs, "doc_id long, text string, score double")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.score(table, spark.createDataFrame([(i, f(t) if held(i) else t) for i, t in labels], "doc_id long, toxic int")).collect()}
        for f in (lambda t: t, lambda t: 1 - t, lambda t: 1, lambda t: None)
    ]
    assert all(s == scores[0] for s in scores)


def slow_kneser_ney(found, order):
    """found: word -> (documents of class 0, of class 1). Probability of a byte after a context, as (ordinary, toxic, both)."""
    n = [defaultdict(lambda: [0, 0]) for _ in range(order + 1)]
    for word, counts in found.items():
        for p in range(1, len(word)):
            k = min(order, p)
            for c in (0, 1):
                n[k][word[p - k : p + 1]][c] += counts[c]
    for k in range(order - 1, -1, -1):
        for gram, counts in n[k + 1].items():
            for c in (0, 1):
                n[k][gram[1:]][c] += counts[c] > 0
    with_both = [{g: (a, b, a + b) for g, (a, b) in level.items()} for level in n]

    def discount(k, c):
        once, twice = (sum(v[c] == x for v in with_both[k].values()) for x in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    d = [[discount(k, c) for c in range(3)] for k in range(order + 1)]

    def prob(context, byte, k):
        if k < 0:
            return [1 / 256] * 3
        low = prob(context[1:], byte, k - 1)
        gram = context + byte
        if gram not in with_both[k]:
            return low
        same = [v for g, v in with_both[k].items() if g[:-1] == context]
        total = [sum(v[c] for v in same) for c in range(3)]
        backoff = [sum(min(v[c], d[k][c]) for v in same) for c in range(3)]
        seen = [max(with_both[k][gram][c] - d[k][c], 0) for c in range(3)]
        both = (seen[2] + backoff[2] * low[2]) / total[2]
        return [(seen[c] + backoff[c] * both) / total[c] if total[c] else low[c] for c in (0, 1)] + [both]

    return prob


def test_kneser_ney_probabilities_equal_brute_force():
    r = random.Random(4)
    found = {b"\0" + bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) + b"\0": (r.randint(0, 3), r.randint(0, 2)) for _ in range(60)}
    words = list(found)
    model = toxicity.Model(toxicity.levels_of(words, np.array([found[w] for w in words]).T, 3), 3)
    asked = [*words[:20], b"\0abca\0", b"\0zz\0", b"\0\0"]
    p, word = model.probabilities(asked)
    slow = slow_kneser_ney(found, 3)
    at = 0
    for i, w in enumerate(asked):
        for q in range(1, len(w)):
            assert word[at] == i and p[:, at] == pytest.approx(slow(w[max(0, q - 3) : q], w[q : q + 1], min(3, q)), rel=1e-4)
            at += 1
    assert at == p.shape[1]


def test_a_trie_is_made_in_little_more_memory_than_it_keeps():
    r = np.random.default_rng(1)
    contexts = np.tile(r.integers(97, 123, (30_000, 4)), (8, 1)).astype(np.uint64)
    grams = r.integers(60, 180, len(contexts)).astype(np.uint64)
    for back in range(4):
        grams |= contexts[:, back] << np.uint64(8 * (back + 1))
    grams = np.unique(grams)
    tracemalloc.start()
    trie = ppm.Trie(grams, np.ones(len(grams)), 4)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(trie.names[4]) > 25_000 and peak < 2 * kept
