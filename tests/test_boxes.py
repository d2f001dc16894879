import random

from pyspark.sql import functions as F

from tablescribe.operators import boxes, graph, joins, series

BOX = "page string, id long, x0 double, y0 double, x1 double, y1 double, confidence double"


def some(seed, n, wide=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 300), r.randint(0, 200)
        out.append(("p%d" % (i % 2), i, float(x), float(y), float(x + r.randint(1, wide)), float(y + r.randint(1, 40)), r.randint(0, 9) / 10))
    return out


def share(a, b):
    w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
    return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)


def test_suppression_equals_a_slow_one(spark):
    rows = some(1, 120)
    want = []
    for page in ("p0", "p1"):
        kept = []
        for b in sorted((b for b in rows if b[0] == page), key=lambda b: (-b[6], b[1])):
            if all(share(a, b) <= 0.3 for a in kept):
                kept.append(b)
        want += [b[1] for b in kept]
    got = boxes.suppress(spark.createDataFrame(rows, BOX), ["page"], "confidence", "id", 0.3)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_overlaps_of_short_long_empty_reversed_and_null_spans(spark):
    r = random.Random(2)
    spans = lambda n: [(i, float(a), float(a + r.choice([0, 1, 5, 90, 5000, -3]))) for i in range(n) for a in [r.randint(-500, 500)]] + [(n, None, 3.0), (n + 1, 1.0, None)]
    a, b = spans(60), spans(50)
    da = spark.createDataFrame(a, "a long, alo double, ahi double").withColumn("__k", F.lit(1))
    db = spark.createDataFrame(b, "b long, blo double, bhi double").withColumn("l", F.lit(2))
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] < x[2]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] < y[2] and y[1] < x[2])
    got = joins.overlaps(da.withColumn("g", F.lit(1)), db.withColumn("g", F.lit(1)), ["g"], ("alo", "ahi"), ("blo", "bhi"), 4.0)
    assert sorted((x["a"], x["b"]) for x in got.collect()) == want
    points = spark.createDataFrame([(i, float(r.randint(-600, 600))) for i in range(80)] + [(99, None)], "p long, at double")
    inside = joins.points_in_ranges(points, "at", db, "blo", "bhi", 4.0)
    flat = [(x["p"], x["at"]) for x in points.collect() if x["at"] is not None]
    assert sorted((x["p"], x["b"]) for x in inside.collect()) == sorted((p, y[0]) for p, at in flat for y in b if y[1] is not None and y[2] is not None and y[1] <= at <= y[2])


def test_anti_union_keeps_repeats_and_rows_without_a_span(spark):
    schema = "g int, lo double, hi double, __row int"
    a = spark.createDataFrame([(1, 0.0, 5.0, 1), (1, 0.0, 5.0, 1), (1, 20.0, 25.0, 2), (1, None, 3.0, 3), (1, 9.0, 2.0, 4), (None, 0.0, 5.0, 5)], schema)
    b = spark.createDataFrame([(1, 22.0, 23.0, 9), (1, None, None, 8)], schema)
    got = sorted(r["__row"] for r in joins.anti_union(a, b, ["g"], "lo", "hi", 4.0).collect())
    assert got == [1, 1, 3, 4, 5, 8, 9]


def test_boxes_with_null_sides_and_empty_tables(spark):
    rows = some(3, 30) + [("p0", 900, None, 1.0, 2.0, 3.0, 0.5), ("p0", 901, 50.0, 1.0, 2.0, 3.0, 0.5)]
    df, none = spark.createDataFrame(rows, BOX), spark.createDataFrame([], BOX)
    other = spark.createDataFrame(some(4, 30), BOX)
    means = {r["id"]: r["mean"] for r in boxes.overlap_mean(df, other, ["page"], ["id"], "confidence", 30.0).collect()}
    assert len(means) == 32 and means[900] is None and means[901] is None
    for row in some(3, 30):
        met = [b[6] for b in some(4, 30) if b[0] == row[0] and b[2] < row[4] and row[2] < b[4] and b[3] < row[5] and row[3] < b[5]]
        assert (means[row[1]] is None) == (not met) and (not met or abs(means[row[1]] - sum(met) / len(met)) < 1e-9)
    assert boxes.overlapping(df, none, ["page"], 30.0).count() == 0 and boxes.suppress(none, ["page"], "confidence", "id", 0.3).count() == 0
    assert boxes.overlap_mean(df, none, ["page"], ["id"], "confidence", 30.0).where("mean is not null").count() == 0


def test_nearest_centres_with_ties_and_without_centres(spark):
    points = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 5.0), ("a", 3, 99.0), ("a", 4, None), ("b", 5, 1.0)], "g string, id int, x double")
    centres = spark.createDataFrame([("a", 0.0, 7), ("a", 10.0, 2), ("a", 10.0, 5)], "g string, at double, i int")
    got = {r["id"]: r["n"] for r in boxes.nearest_centre(points, "x", centres, "at", "i", ["g"], "n", 20.0).collect()}
    assert got == {1: 7, 2: 2, 3: None, 4: None, 5: None}


def test_lines_by_overlap_equal_a_slow_walk(spark):
    r = random.Random(6)
    rows = [("p%d" % (i % 3), i, float(a), float(a + r.randint(3, 12))) for i in range(90) for a in [r.randint(0, 150)]]
    got = {x["id"]: x["line"] for x in series.lines_by_overlap(spark.createDataFrame(rows, "page string, id int, lo double, hi double"), ["page"], "lo", "hi", "id", 0.5).collect()}
    for page in ("p0", "p1", "p2"):
        lines = []
        for _, i, a, b in sorted((x for x in rows if x[0] == page), key=lambda x: (x[2], x[3], x[1])):
            found = [(min(b, y) - max(a, x), k) for k, (x, y) in enumerate(lines) if k >= len(lines) - 6 and min(b, y) - max(a, x) >= 0.5 * min(b - a, y - x)]
            if found:
                k = max(found)[1]
                lines[k] = (min(a, lines[k][0]), max(b, lines[k][1]))
            else:
                k = len(lines)
                lines.append((a, b))
            assert got[i] == k


def test_components_and_dense_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert graph.components(edges.where("false")).count() == 0
    labels = spark.createDataFrame([("d", "x", 3), ("d", "y", 1), ("d", "x", 0), ("d", None, 9)], "d string, l string, o int")
    assert {r["l"]: r["dense"] for r in graph.dense_labels(labels, ["d"], "l", ["o"]).collect()} == {"x": 0, "y": 1, None: 2}


def test_overlapping_boxes_and_their_candidates(spark):
    r = random.Random(9)
    sizes = [1, 5, 20, 60, 900]
    rows = lambda n: [("p%d" % (i % 2), i, float(x), float(y), float(x + r.choice(sizes)), float(y + r.choice(sizes)), 0.5) for i in range(n) for x, y in [(r.randint(-300, 3000), r.randint(-300, 3000))]]
    a, b = rows(150), rows(130)
    odd = [("p0", 900, None, 1.0, 2.0, 3.0, 0.1), ("p0", 901, 9.0, 1.0, 2.0, 3.0, 0.1)]
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[4] and y[2] < x[4] and x[3] < y[5] and y[3] < x[5])
    da, db = spark.createDataFrame(a + odd, BOX), spark.createDataFrame(b + odd, BOX)
    assert sorted((p["a_id"], p["b_id"]) for p in boxes.overlapping(da, db, ["page"], 20.0).collect()) == want
    spread = [("p", i, float(x), float(y), float(x + 40), float(y + 30), 0.5) for i in range(4000) for x, y in [(r.randint(0, 4000), r.randint(0, 4000))]]
    ds = spark.createDataFrame(spread, BOX)
    met = boxes.overlapping(ds, ds, ["page"], 40.0).count()
    assert boxes.overlap_candidates(ds, ds, ["page"], 40.0).count() <= 5 * met


def test_id_pairs_of_equal_boxes(spark):
    rows = [("p", i, 0.0, 0.0, 10.0, 10.0) for i in (1, 5, 9)] + [("p", 3, 1.0, 0.0, 11.0, 10.0), ("q", 4, 1.0, 0.0, 11.0, 10.0), ("p", None, 0.0, 0.0, 10.0, 10.0), ("p", 8, None, 0.0, 1.0, 1.0)]
    got = boxes.id_pairs(spark.createDataFrame(rows, "page string, id long, x0 double, y0 double, x1 double, y1 double"), ["page"], "id", 0.5, 20.0)
    assert sorted((r["a_id"], r["b_id"], round(r["iou"], 4)) for r in got.collect()) == [(1, 3, 0.8182), (1, 5, 1.0), (1, 9, 1.0), (3, 5, 0.8182), (3, 9, 0.8182), (5, 9, 1.0)]
