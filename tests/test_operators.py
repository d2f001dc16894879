import random

from pyspark.sql import functions as F

from tablescribe.operators import aggregates, joins, windows


def test_medians_modes_and_votes(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 5), ("a", 3.0, 1), ("a", 10.0, 1), ("b", None, 1), ("c", 2.0, 1), ("c", 2.0, 1), ("c", 4.0, 1), ("c", 4.0, 1)], "g string, v double, w int")
    assert {r[0]: r[1] for r in aggregates.upper_median(df, ["g"], "v").collect()} == {"a": 3.0, "c": 4.0}
    assert {r[0]: r[1] for r in aggregates.weighted_median(df, ["g"], "v", "w").collect()} == {"a": 2.0, "c": 2.0}
    assert {r[0]: r[1] for r in aggregates.mode_larger(df.where("g = 'c'"), ["g"], "v").collect()} == {"c": 4.0}
    readings = spark.createDataFrame([(1, "x", 0.2), (1, "y", 0.9), (1, "x", 0.1), (2, "p", 0.5), (2, "q", 0.7)], "cell int, value string, score double")
    assert {r["cell"]: r["winner"] for r in aggregates.vote(readings, ["cell"], "value", "score").collect()} == {1: "x", 2: "q"}


def test_weighted_mean_leaves_missing_parts_out(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(aggregates.weighted_mean([(F.col("a"), 1.0), (F.col("b"), 3.0)])).collect()]
    assert got == [1.0, None, 0.75]


def test_islands_collapse_and_first(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 0, 0, 1, 0, 1, 1, 0, 0, 0])], "g string, i int, v int")
    got = windows.islands(df, ["g"], ["i"], F.col("v") == 0, 2).collect()
    assert sorted((r["first"], r["last"], r["rows"]) for r in got) == [(1, 2, 2), (7, 9, 3)]
    assert [r["i"] for r in windows.collapse(df.withColumn("t", F.col("v").cast("string")), ["g"], ["i"], "t", "1").orderBy("i").collect()] == [1, 4, 7]
    assert sorted((r["i"], r["copies"]) for r in windows.keep_first(df, [F.col("v")], ["i"]).collect()) == [(0, 4), (1, 6)]


def test_bucketed_joins_equal_nested_loops(spark):
    r = random.Random(2)
    a = [(i, r.choice("xy"), *sorted((r.uniform(-50, 50), r.uniform(-50, 50)))) for i in range(60)]
    b = [(100 + i, r.choice("xy"), *sorted((r.uniform(-50, 50), r.uniform(-50, 50)))) for i in range(15)]
    A, B = spark.createDataFrame(a, "id int, k string, lo double, hi double"), spark.createDataFrame(b, "id int, k string, lo double, hi double")
    meets = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    pairs = joins.overlaps(A, B.select(F.col("id").alias("j"), "k", F.col("lo").alias("l"), F.col("hi").alias("h")), ["k"], ("lo", "hi"), ("l", "h"), 7.0).collect()
    assert sorted((p["id"], p["j"]) for p in pairs) == sorted(meets)
    rest = joins.anti_union(A, B, ["k"], "lo", "hi", 7.0).collect()
    assert sorted(x["id"] for x in rest) == sorted([x[0] for x in a if not any(x[0] == m for m, _ in meets)] + [y[0] for y in b])
    inside = joins.points_in_ranges(A.select("id", F.col("lo").alias("at")), "at", B.select(F.col("id").alias("j"), "lo", "hi"), "lo", "hi", 7.0).collect()
    assert sorted((p["id"], p["j"]) for p in inside) == sorted((x[0], y[0]) for x in a for y in b if y[2] <= x[2] <= y[3])


def test_nearest(spark):
    got = joins.nearest(spark.createDataFrame([(0.0,), (5.0,), (99.0,), (None,)], "v double"), "v", [0.0, 10.0], 20.0).collect()
    assert [r["nearest"] for r in got] == [0, 0, None, None]


def test_nearest_word_compares_with_the_whole_vocabulary(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(8)
    words = {"old", "cold", "bolt", "blue", "", "é", "gear", "bear"} | {"".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(150)}
    table = spark.createDataFrame([(w,) for w in [*sorted(words), None, "old"]], "word string")
    for most in (1, 3):
        want = {}
        for a in words:
            near = [(e, b) for b in words if b != a and (e := edits(a, b)) <= most]
            if near:
                want[a] = min(near)
        got = joins.nearest_word(table, table, most).collect()
        assert len(got) == len(want) and {g["word"]: (g["edits"], g["nearest"]) for g in got} == want
