import random

from tablescribe.operators import borders

SCHEMA = "page string, id long, flat boolean, x0 double, y0 double, x1 double, y1 double"
H = lambda y, a, b: (y, a, b)
FRAME = [(95, 245, 1800), (1405, 245, 1800)]
HEADER, ITEMS = [(540, 245, 650), (975, 245, 650)], [(x, 650, 1800) for x in (165, 285, 520, 615, 705, 810, 905, 1000, 1090, 1195, 1290)]


def test_one_frame_around_a_boxed_header_and_the_items():
    flats = [H(245, 95, 1405), H(385, 95, 1405), H(650, 95, 1405), *[H(y, 95, 1405) for y in range(690, 1801, 35)]]
    parts = borders.sections(flats, sorted(FRAME + HEADER + ITEMS), 95, 1405, 24)
    assert [flats[a][0] for a, *_ in parts] == [245, 650] and parts[-1][1] == len(flats) - 1 and parts[1][2] > parts[0][2]
    apart = [(565, 245, 650), (950, 245, 650)]  # farther than the tolerance from every other separator
    got = borders.grid_layout(flats, FRAME + apart + ITEMS, (95, 245, 1405, 1800), 2000, 24)
    assert got["splits"] == [650] and got["top"] == 650 and got["bottom"] == flats[-1][0] and got["kind"] == "full-grid"
    assert got["columns"] == sorted([95, 1405, *(x for x, *_ in ITEMS)]) and got["rows"][0] == 650


def test_grids_that_stay_whole_and_one_that_does_not():
    whole = lambda flats, steeps, low: borders.grid_layout(flats, steeps, (95, 245, 1405, low), 800, 24)["splits"] == []
    assert whole([H(y, 95, 1405) for y in (245, 280, 315, 350)], [(95, 245, 350), (400, 245, 350), (900, 245, 350), (1405, 245, 350)], 350)
    assert whole([H(y, 95, 1405) for y in (245, 285, 320, 355)], [(95, 245, 355), (1405, 245, 355), (400, 285, 355), (900, 285, 355)], 355)
    assert whole([H(y, 95, 1405) for y in (245, 650, 1800)], FRAME + [(540, 245, 1800), (975, 245, 1800)], 1800)
    two = borders.grid_layout([H(y, 95, 1405) for y in (245, 650, 1800)], FRAME + HEADER + [(300, 650, 1800), (700, 650, 1800), (1100, 650, 1800)], (95, 245, 1405, 1800), 2000, 24)
    assert two["splits"] == [650] and two["top"] == 650
    assert borders.grid_layout([H(10, 0, 100), H(40, 0, 100)], [(0, 10, 40), (50, 10, 40)], (0, 10, 100, 40), 1000, 6)["kind"] == "header-box"
    assert borders.merged([(10, 0, 5), (12, 0, 50), (30, 0, 9)], 4) == [(12, 0, 50), (30, 0, 9)]


def test_crossings_and_grids_against_all_pairs(spark):
    r = random.Random(6)
    rows = []
    for k in range(240):
        a, b, size = r.randint(0, 900), r.randint(0, 900), r.choice([5, 40, 300, 900])
        rows.append((f"p{k % 3}", k, k % 2 == 0, float(a), float(b), float(a + size * (k % 2 == 0)), float(b + size * (k % 2 == 1))))
    rows += [("p0", 900, True, None, 1.0, 2.0, 1.0), ("p0", 901, True, 9.0, 1.0, 2.0, 1.0)]
    ok = [x for x in rows if x[1] < 900]
    want = {(h[1], v[1]) for h in ok for v in ok if h[2] and not v[2] and h[0] == v[0] and h[3] - 3 <= v[3] <= h[5] + 3 and v[4] - 3 <= h[4] <= v[6] + 3}
    rules = spark.createDataFrame(rows, SCHEMA)
    crossed = borders.crossings(rules, ["page"], 3.0, 50.0).cache()
    assert sorted((x["h"], x["v"]) for x in crossed.collect()) == sorted(want)
    root = {x[1]: x[1] for x in ok}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for h, v in want:
        a, b = sorted((find(h), find(v)))
        root[b] = a
    groups = {}
    for x in ok:
        groups.setdefault(find(x[1]), []).append(x)
    sizes = {g: (sum(x[2] for x in own), sum(not x[2] for x in own), sum(find(h) == g for h, _ in want), min(x[3] for x in own), max(x[6] for x in own)) for g, own in groups.items()}
    got = borders.grids(rules, crossed, ["page"]).collect()
    assert {x["grid"]: (x["flats"], x["steeps"], x["crossings"], x["x0"], x["y1"]) for x in got} == {g: s for g, s in sizes.items() if s[0] > 1 and s[1] > 1}
    laid = borders.layouts(rules, crossed, ["page"], 1000.0, 3.0).collect()
    assert sorted(x["grid"] for x in laid) == sorted(x["grid"] for x in got if x["nth"] == 1)
