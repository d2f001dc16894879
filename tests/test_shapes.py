import random

from tablescribe.operators import shapes


def test_hull_holds_all_points_and_has_no_dents(spark):
    r = random.Random(3)
    points = [("a", float(r.randint(0, 20)), float(r.randint(0, 20))) for _ in range(60)] + [("b", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0), ("c", 2.0, 2.0), ("c", None, 1.0)]
    rows = shapes.convex_hull(spark.createDataFrame(points, "g string, x double, y double"), ["g"], "x", "y").collect()
    hull = {g: [(r["x"], r["y"]) for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["place"])] for g in "abc"}
    assert hull["b"] == [(1.0, 1.0)] and sorted(hull["c"]) == [(0.0, 0.0), (2.0, 2.0)]
    corners = hull["a"]
    turn = lambda p, q, t: (q[0] - p[0]) * (t[1] - p[1]) - (q[1] - p[1]) * (t[0] - p[0])
    for p, q in zip(corners, corners[1:] + corners[:1]):
        assert all(turn(p, q, (x, y)) >= 0 for g, x, y in points if g == "a")
    assert all(turn(corners[i - 2], corners[i - 1], corners[i]) > 0 for i in range(len(corners)))


def test_simplified_lines_stay_within_the_tolerance(spark):
    r = random.Random(4)
    line = [("a", i, float(i), r.random() * 10) for i in range(80)]
    kept = sorted((x["i"], x["x"], x["y"]) for x in shapes.simplified(spark.createDataFrame(line, "g string, i int, x double, y double"), ["g"], "i", "x", "y", 2.0).collect())
    assert kept[0][0] == 0 and kept[-1][0] == 79 and len(kept) < 80
    for (a, ax, ay), (b, bx, by) in zip(kept, kept[1:]):
        for _, i, x, y in line[a + 1 : b]:
            assert abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 <= 2.0


def test_peaks_and_hosts(spark):
    v = spark.createDataFrame([("a", x) for x in (1.0, 1.2, 1.5, 2.5, 9.0)] + [("b", None)], "g string, v double")
    assert [(r["g"], r["bin"], r["n"]) for r in shapes.histogram_peak(v, ["g"], "v", 0.0, 10.0, 10).collect()] == [("a", 1, 3)]
    box = "g string, id int, x0 double, y0 double, x1 double, y1 double"
    rows = spark.createDataFrame([("a", 1, 0.0, 0.0, 9.0, 10.0), ("a", 2, 0.0, 50.0, 9.0, 60.0), ("a", 3, 0.0, None, 9.0, 60.0)], box)
    hosts = spark.createDataFrame([("a", 7, 0.0, 2.0, 5.0, 20.0), ("a", 8, 0.0, -4.0, 5.0, 6.0)], box)
    assert {r["id"]: r["host"] for r in shapes.host_rows(rows, hosts, ["g"], "id", 0.5, 10.0).collect()} == {1: 7, 2: None, 3: None}
