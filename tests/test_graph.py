import math
import random

from tablescribe.operators import graph


def one_at_a_time(nodes, edges, least):
    nodes, edges = {n[0]: list(n[1:]) for n in nodes}, [list(e) for e in edges if e[0] != e[1]]
    root = {n: n for n in nodes}
    while edges:
        a, b, score = min(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2])))
        if score < least:
            break
        a, b = min(a, b), max(a, b)
        x, y = nodes[a], nodes.pop(b)
        nodes[a] = [x[0] + y[0], math.floor((x[1] + y[1]) / 2 + 0.5), math.floor((x[2] + y[2]) / 2 + 0.5), min(x[3], y[3]), min(x[4], y[4]), max(x[5], y[5]), max(x[6], y[6])]
        edges = [[a if i == b else i for i in e[:2]] + [e[2]] for e in edges]
        edges = [e for e in edges if e[0] != e[1]]
        root = {n: a if r == b else r for n, r in root.items()}
    return nodes, root


def test_merges_equal_one_at_a_time(spark):
    r = random.Random(2)
    nodes = [(k, r.randint(1, 50), float(r.randint(0, 90)), float(r.randint(0, 90)), float(k), float(k % 7), float(k + 5), float(k % 7 + 3)) for k in range(60)]
    scores = r.sample(range(1000), 140)
    edges = [(r.randrange(60), r.randrange(60), s / 1000) for s in scores]
    now, roots = graph.heaviest_merges(spark.createDataFrame(nodes, "id long, area long, cx double, cy double, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(edges, "a long, b long, score double"), 0.55)
    want, root = one_at_a_time(nodes, edges, 0.55)
    assert {x["root"] for x in roots.collect()} == set(want)
    assert {x["node"]: x["root"] for x in roots.collect()} == root
    assert {x["id"]: list(x)[1:] for x in now.collect()} == want
