import random

import pytest
from pyspark.sql import functions as F

from tablescribe.operators import headers

ACME = ["Category & Product Name", "Pack Size.", "Batch No.", "Qty", "Trade", "VAT", "Trade", "VAT", "%", "Value", "Net Value"]
SHORT = ["Product Name", "Pack", "Batch", "T.P", "VAT", "Qnty", "TP+VAT", "Net Val"]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(name, k, t) for name, titles in (("acme", ACME), ("short", SHORT)) for k, t in enumerate(titles)], "rule string, ci int, label string")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page int, x double, text string")


def test_words_of_titles(spark):
    cases = {"0/0": ["pct"], "%": ["pct"], "Disc %": ["disc", "pct"], "T.P": ["tp"], "T. P": ["tp"], "Exp. Date": ["exp", "date"], "S. No": ["s", "no"], "TP(TK) /PACK": ["tp", "tk", "pack"], "": [], None: []}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", headers.title_words(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in got} == cases


def test_printed_title_row_finds_its_rule(spark, rules):
    """The titles of one rule with the words of a customer block above them."""
    row = [("Customer", 40), ("Name", 110), ("and", 160), ("Address:", 200), ("Product", 40), ("Name", 110), ("Pack", 280), ("Batch", 370), ("T.P", 450), ("VAT", 520), ("anty", 580), ("TP+VAT", 660), ("Net", 760), ("Val", 800)]
    words = pages(spark, [(1, float(x), t) for t, x in row] + [(2, 0.0, "Foo"), (2, 5.0, "Bar"), (2, 9.0, "Trade"), (3, None, "Pack"), (3, 1.0, None)])
    best = headers.best_rules(headers.alignments(words, rules, ["page"]), rules, ["page"]).collect()
    assert [(r["page"], r["rule"], r["found"], r["total"], r["exact"]) for r in best] == [(1, "short", 8, 8, True)]


def test_misread_titles_and_another_order(spark, rules):
    words = pages(spark, [(1, 10.0 * k, t) for k, t in enumerate(["Category & Produdt Name", "Pack Size.", "Batch No.", "Qty", "Trade Per pa", "ck VAT", "Value Trade", "VAT", "0/0", "Discount Value", "Net Value"])] + [(2, 10.0 * (9 - k), t) for k, t in enumerate(SHORT)])
    best = {r["page"]: r for r in headers.best_rules(headers.alignments(words, rules, ["page"]), rules, ["page"]).collect()}
    assert best[1]["rule"] == "acme" and best[1]["found"] == 11 and best[1]["exact"] and best[2]["found"] < 5 and not best[2]["exact"]


def heaviest(words, titles, alike):
    """Plain table over both sequences with the way back."""
    m, n = len(titles), len(words)
    best = [[0.0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            v = alike.get((i, j), 0)
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + v if v else 0)
    return best[m][n]


def test_chain_is_the_heaviest():
    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        m, n = r.randint(1, 7), r.randint(1, 9)
        cells = {(r.randint(1, m), r.randint(1, n)): r.choice([0.4, 0.7, 0.75, 1.0]) for _ in range(r.randint(1, 14))}
        i, j = (np.array(x) for x in zip(*cells))
        chain = headers.heaviest_chain(m, n, i, j, np.array(list(cells.values())))
        assert all(a[0] > b[0] and a[1] > b[1] for a, b in zip(chain, chain[1:]))
        assert abs(sum(v for *_, v in chain) - heaviest(range(n), range(m), cells)) < 1e-9


def test_layout_on_gutters():
    got = headers.boundaries_on_gutters([0.0, 0.3, 0.31, 0.4, 0.41, 0.5, 0.51, 1.0], 200, 2200, [(790, 812, False), (1000, 1010, False), (1900, 1910, False)], 20)
    assert got[0] == (200, 789, True) and got[1] == (813, 999, True) and got[2][0] == 1011
    assert abs(got[2][1] - 1200) <= 2 and abs(got[3][0] - 1200) <= 2 and got[2][1] < got[3][0] and not got[2][2] and got[3][1] == 2200
    assert headers.boundaries_on_gutters([0.0, 1.0], 0, 9, [], 1) == [(0, 9, True)]
    shallow = headers.boundaries_on_gutters([0.0, 0.5, 0.5, 1.0], 0, 1000, [(430, 440, False), (470, 480, True)], 10)
    assert shallow[0][1] == 429  # the deeper one a little farther off


def test_layouts_over_pages(spark):
    layouts = spark.createDataFrame([("a", 0, 0.0, 0.5), ("a", 1, 0.5, 1.0)], "layout string, ci int, x0f double, x1f double")
    of_pages = spark.createDataFrame([(1, "a", 0, 100, 5), (2, "a", 0, 100, 5), (3, "b", 0, 100, 5)], "page int, layout string, x0 int, x1 int, glyph int")
    gutters = spark.createDataFrame([(1, 44, 47, False), (3, 50, 52, False)], "page int, lo int, hi int, shallow boolean")
    got = {(r["page"], r["ci"]): (r["x0"], r["x1"], r["from_gutter"]) for r in headers.layout_over_pages(layouts, of_pages, gutters, "layout", "page").collect()}
    assert got == {(1, 0): (0, 43, True), (1, 1): (48, 100, True), (2, 0): (0, 48, False), (2, 1): (52, 100, True)}


def test_nothing(spark, rules):
    none = pages(spark, [])
    assert headers.best_rules(headers.alignments(none, rules, ["page"]), rules, ["page"]).count() == 0
