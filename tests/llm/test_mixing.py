import heapq

import pytest

from tablescribe.llm import mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    left, want, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        level = left / sum(w[i] for i in free) if free else 0
        over = [i for i in free if w[i] * level > cap * sizes[i]]
        if not over:
            for i in free:
                want[i] = w[i] * level
            return want
        for i in over:
            want[i] = cap * sizes[i]
            left -= want[i]
            free.discard(i)


def test_apportionment_equals_seats_given_one_by_one(spark):
    groups = {"a": ([5.0, 3.0, 1.0, 0.0, 1.0, 1.0], 23), "b": ([1000.0, 1.0, 1.0, 1.0, 2.0], 40), "c": ([7.0], 9), "d": ([0.0, 0.0], 0), "e": ([1.0] * 7, 3)}
    rows = [(g, i, v, n) for g, (votes, n) in groups.items() for i, v in enumerate(votes)]
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(spark.createDataFrame(rows, "g string, i long, v double, n long"), ["g"], ["i"], "v", "n").collect()}
    for g, (votes, n) in groups.items():
        seats, heap = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v]
        heapq.heapify(heap)
        for _ in range(n):
            _, i = heapq.heappop(heap)
            seats[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * seats[i] + 1), i))
        assert [got[g, i] for i in range(len(votes))] == seats


def test_targets(spark):
    for sizes in ([10, 1000, 5, 70, 0, 300], [1], [0, 0], [5, 5, 5, 5]):
        rows = [(None if i == len(sizes) - 1 else f"s{i}", n) for i, n in enumerate(sizes)]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        assert [got[s] for s, _ in rows] == pytest.approx(slow_targets(sizes))


def test_documents(docs, nothing, texts):
    first, second = (sorted(map(tuple, mixing.mix(docs).select("source", "size", "source_size", "target", "taken", "first").collect()), key=str) for _ in range(2))
    assert first == second and len(first) == len(texts)
    totals, want, size = {}, {}, {}
    for source, n, source_size, target, taken, _ in first:
        assert 0 <= taken <= 2 * n
        totals[source] = totals.get(source, 0) + taken
        size[source] = size.get(source, 0) + n
        want[source] = target
    rows = sorted(size, key=lambda s: (s is None, s))
    assert [want[s] for s in rows] == pytest.approx(slow_targets([size[s] for s in rows]))
    for s in rows:
        assert abs(totals[s] - want[s]) <= 2 * 64
    assert mixing.mix(nothing).count() == 0


def test_mixed_texts_hold_the_words_taken(docs, nothing):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    assert got == sum(r["taken"] for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(nothing).count() == 0
