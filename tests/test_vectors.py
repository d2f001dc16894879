import math
import random

from tablescribe.operators import joins, shapes, vectors

ROWS = "id long, g int, v array<float>"


def some(seed, n, copies=0):
    r = random.Random(seed)
    rows = [(i, r.randint(0, 2), [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(5)]) for i in range(n)]
    rows += [(n + k, 1, [0.5, 1.0, 0.0, 1.0, 0.5]) for k in range(copies)]
    return rows + [(900, 1, None), (901, 1, [1.0, None, 0.0, 0.0, 0.0]), (902, 1, [1.0, 2.0]), (903, None, [1.0] * 5)]


def cosine(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    dot = lambda p, q: sum(a * b for a, b in zip(p, q))
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)) + 1e-10)


def test_similar_pairs_equal_all_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_BLOCK", 8)
    monkeypatch.setattr(vectors, "_ROWS", 3)
    rows = some(1, 90)
    want = sorted((a, b, round(c, 6)) for a, g, x in rows for b, h, y in rows if a < b and g is not None and g == h for c in [cosine(x, y)] if c is not None and round(c, 6) >= 0.4)
    got = shapes.similar_pairs(spark.createDataFrame(rows, ROWS), ["g"], "id", "v", 0.4)
    assert sorted(map(tuple, got.collect())) == want


def test_ratio_matches_equal_all_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_BLOCK", 8)
    monkeypatch.setattr(vectors, "_ROWS", 3)
    rows = some(2, 60, copies=40)
    want = []
    for a, g, x in rows:
        near = sorted((-round(c, 9), b, c) for b, h, y in rows if a != b and g is not None and g == h for c in [cosine(x, y)] if c is not None)
        if len(near) > 1 and round(1 - near[0][2], 9) <= 0.9 * round(1 - near[1][2], 9):
            want.append((a, near[0][1], round(near[0][2], 6)))
    got = joins.ratio_matches(spark.createDataFrame(rows, ROWS), ["g"], "id", "v", 0.9)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
