import random

import numpy as np

from tablescribe.llm import multi_index
from tests.llm.test_simhash import union


def vectors():
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 16))
    rows = list(base)
    for i in range(40):
        for _ in range(i % 7):
            rows.append(base[i] + 0.12 * r.normal(size=16))
    rows += [base[3]] * 25 + [base[0] * 4.0]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_links_components_and_odd_vectors(spark):
    rows = vectors()
    n = len(rows)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [1.0] * 15), (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, i, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, cid long, n long")
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(table, block=16, batch=32).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    want = close.sum(axis=1)
    links = np.array([got[i]["n_links"] for i in range(n)])
    assert (links <= want).all() and links.sum() >= 0.95 * want.sum()
    root = union(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(close)) if a < b])
    assert np.mean([got[i]["component_id"] == root[i] for i in range(n)]) >= 0.95
    for i, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_nothing_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert multi_index.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = multi_index.near_duplicates(spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [2.0, 4.0]), (7, [1.0, -2.0])], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == [("5", 2, 5), ("5", 2, 5), ("7", 0, 7), ("None", 2, 5)]


def test_forest_connects_what_the_hits_connect():
    r = random.Random(1)
    for _ in range(50):
        n, m = r.randint(1, 12), r.randint(1, 12)
        hits = np.array([[r.random() < 0.15 for _ in range(m)] for _ in range(n)])
        left, right = np.arange(n), np.arange(100, 100 + m)
        edges = multi_index.forest(hits, left, right)
        nodes = [*map(int, left), *map(int, right)]
        assert union(nodes, edges) == union(nodes, [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(hits))])


def test_visits_are_the_nearest_cells():
    r = np.random.default_rng(0)
    index = multi_index.Index(r.normal(size=(6, 4)), r.normal(size=(5, 4)), 11)
    u = r.normal(size=(40, 8))
    places = index.ranks(u)
    for row, cells in enumerate(index.nearest(u)):
        assert sorted(places[row, cells]) == list(range(11)) and places[row, cells[0]] == 0


def test_rare_links_at_the_least_cosine_are_found(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.normal(size=(40, 64))
    side -= (side * x[:40]).sum(axis=1)[:, None] * x[:40]
    c = 0.905
    x[100:140] = c * x[:40] + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1)[:, None]
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(x)]
    got = {g["vec_id"]: g for g in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = [i for i in range(40) if got[100 + i]["component_id"] == i and got[i]["n_links"] == got[100 + i]["n_links"] == 1]
    assert len(found) >= 38
    assert sum(g["n_links"] for g in got.values()) == 2 * len(found)


def test_vectors_link_with_those_of_their_length(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.01, 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.01]), (6, [2.0]), (7, [3.0]), (8, [0.0, 0.0, 1.0])]
    got = multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (0, 1), 2: (0, 2), 3: (1, 3), 8: (1, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}
