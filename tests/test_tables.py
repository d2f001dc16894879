import json

from pyspark.sql import functions as F

from tablescribe.functions import amounts, groups, packs
from tablescribe.operators import evidence, numcheck, pages, products, tables
from tablescribe.plans.rows import FRAGMENTS


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_pack_sizes(spark):
    texts = ["4X10'S", "1X3X10", "1X1X1", "1X1'S", "4X1 0S", "30's", "30S", "30 PCS", "1x15gm", "100ml", "VIAL", "30", "", None]
    assert values(spark, texts, packs.unit_count) == [40, 30, 1, 1, 40, 30, 30, 30, 1, 1, 1, 30, 1, 1]
    assert values(spark, ["308", "305", "128", "30", None], packs.repaired_count) == ["30S", "30S", None, None, None]
    assert values(spark, ["Adovas Syp 200ml", "Napa Tab 10x10's", "Seclo Cap 30's", "Napa"], packs.pack_at_end) == ["200ml", "10x10's", "30's", None]
    assert values(spark, ["5X98", "10X108", "10X15", "5X95", "308"], lambda t: packs.with_s(t, F.lit("'S"))) == ["5X9'S", "10X10'S", None, "5X9'S", "30'S"]


def test_group_names(spark):
    names = ["RPL", "Square Pharmaceuticals", "05 INJECTION", "10 Tabs", "Sub Total", "Tab", "Tablet 500mg", "A", "", None]
    assert values(spark, names, lambda t: groups.is_group_name(t, FRAGMENTS)) == [True, True, True, False, False, False, False, False, False, False]
    rows = spark.createDataFrame([(["MSD Product", "", "Sub Total", "12"],), (["RPL", "L.", "", ""],), (["", "", "", ""],), ([],), (["Rx Product", "", "MD HABIB", ""],)], "t array<string>")
    got = rows.select(groups.group_name_of(F.col("t"), FRAGMENTS).alias("a"), groups.inside_total(F.col("t"), FRAGMENTS).alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, "MSD Product"), ("RPL", None), (None, None), (None, None), ("Rx Product · MD HABIB", None)]


def test_numbers_of_a_recogniser(spark):
    got = values(spark, ["1 72.42", "13.O4", "449.7B", "9O0.00", "Z", "1,259.44", "337..20", "12%", "abc", "", None], amounts.lenient_number)
    assert [r and r["value"] for r in got] == [172.42, 13.04, 449.78, 900.0, None, 1259.44, 337.20, 12.0, None, None, None]
    assert [r and r["clean"] for r in got] == [False, False, False, False, None, True, True, True, None, None, None]
    pairs = spark.createDataFrame([(112.86, "172.86"), (9.0, "90.0"), (5.0, "123456"), (15.0, ""), (2.0, None), (0.5, "0.50"), (1234.5, "12345")], "v double, t string")
    assert [r[0] for r in pairs.select(amounts.plausible_misread(F.col("v"), F.col("t"))).collect()] == [True, True, False, False, False, True, True]


def test_repair_of_a_table_by_its_identities(spark):
    """The figures of an invoice: a misread unit price's product, a blank net, a blank price with tax, a quantity from the totals."""
    roles = ("qty", "unitTp", "unitVat", "unitGross", "totalTp", "totalVat", "discAmt", "net")
    good = [
        (2.0, 56.43, 9.82, 66.25, 112.86, 19.64, 5.64, 126.86), (3.0, 75.22, 13.09, 88.31, 225.66, 39.27, 11.28, 253.65), (1.0, 61.84, 10.76, 72.60, 61.84, 10.76, 3.09, 69.51),
        (5.0, 13.04, 2.27, 15.31, 65.20, 11.35, 3.26, 73.29), (4.0, 20.00, 3.48, 23.48, 80.00, 13.92, 4.00, 89.92),
    ]
    bad = [list(r) for r in good]
    bad[0][4] = 172.86
    bad[1][7] = None
    bad[2][3] = None
    bad[3][0] = None
    schema = "doc int, line int, " + ", ".join(f"{r} double" for r in roles)
    rows = spark.createDataFrame([(1, i, *r) for i, r in enumerate(bad)] + [(2, 0, *[None] * 8)], schema)
    stats = {r["relation"]: r for r in numcheck.relation_stats(rows.where("doc = 1"), ["doc"], roles).collect()}
    assert stats["ttp"]["tested"] == 4 and stats["ttp"]["held"] == 3 and stats["net5"]["chosen"] and not any(stats[f"net{k}"]["chosen"] for k in (1, 2, 3))
    got = sorted(numcheck.repair(rows, ["doc"], roles).collect(), key=lambda r: (r["doc"], r["line"]))
    for r, want in zip(got, good):
        assert all(abs(r[c] - w) < 0.006 for c, w in zip(roles, want)), (r, want)
        assert r["failed"] == []
    assert [r["fixed"] for r in got] == [["totalTp"], [], [], [], [], []] and [r["filled"] for r in got] == [[], ["net"], ["unitGross"], ["qty"], [], []]
    assert numcheck.repair(rows.where("false"), ["doc"], roles).count() == 0
    assert numcheck.formula_relation("ttp", "{q}*{p}", {"ttp": "totalTp", "q": "qty", "p": "unitTp"}).roles == ("totalTp", "qty", "unitTp")
    assert numcheck.formula_relation("ttp", "{q}*__import__('os')", {"ttp": "totalTp", "q": "qty"}) is None


def test_requests_within_a_budget(spark):
    rows = spark.createDataFrame([("p", 1, 0.9, 50.0), ("p", 2, 0.8, 60.0), ("p", 3, 0.7, 40.0), ("p", 4, 0.7, 5.0), ("q", 5, 0.1, 500.0)], "page string, id int, priority double, px double")
    got = evidence.within_budget(rows, ["page"], "priority", "id", "px", 3, 100.0, 2).collect()
    assert sorted((r["id"], r["wave"]) for r in got) == [(1, 0), (3, 0), (4, 1)]


def test_votes_and_page_order(spark):
    readings = spark.createDataFrame([(1, "A B", "paddle", 0.2), (1, "ab", "local", 0.9), (1, "x", "tess", 0.99), (2, "q", "local", 0.5), (2, "z", "tess", 0.6), (3, "", "local", 1.0)], "c int, t string, e string, s double")
    got = {r["c"]: (r["text"], r["accepted"]) for r in evidence.vote(readings, ["c"], "t", "e", "s", first="paddle").collect()}
    assert got == {1: ("A B", True), 2: ("z", False)}
    families = {r["c"]: r["accepted"] for r in evidence.vote(readings.where("e != 'paddle'"), ["c"], "t", "e", "s", {"local": "t", "tess": "t"}).collect()}
    assert families == {1: False, 2: False}
    p = spark.createDataFrame([("d", 0, 3, None), ("d", 1, 1, None), ("d", 2, None, None), ("e", 0, None, 30), ("e", 1, 2, 1), ("e", 2, 1, None)], "doc string, came int, no int, serial int")
    order = sorted((r["doc"], r["place"], r["came"]) for r in pages.ordered_pages(p, ["doc"], "came", "no", "serial").collect())
    assert [o[2] for o in order] == [1, 0, 2, 1, 0, 2]


def test_rows_as_json_and_product_similarity(spark):
    cells = spark.createDataFrame([(1, "b", "2"), (1, "a", "1"), (1, "a", "0"), (2, "a", None)], "r int, k string, v string")
    got = {r["r"]: json.loads(r["cells"]) for r in pages.row_objects(cells, ["r"], "k", "v").collect()}
    assert got[1] == {"a": "1", "b": "2"} and got[2] in ({}, {"a": None})
    sims = spark.createDataFrame([("CL", "CI"), ("SECL0", "SECLO"), ("NAPA", "NAPA"), ("", "X"), ("ABCD", "ABXY")], "a string, b string").select(products.similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 3) for r in sims] == [0.75, 0.9, 1.0, 0.0, 0.5]
    names, known = spark.createDataFrame([("NAPA",), ("NAPPA",), ("ZZZZ",), (None,)], "n string"), spark.createDataFrame([("NAPA",), ("NAPROX",), (None,)], "f string")
    assert {(r["word"], r["candidate"]) for r in products.candidates(names, "n", known, "f").collect()} == {("NAPA", "NAPA"), ("NAPA", "NAPROX"), ("NAPPA", "NAPA"), ("NAPPA", "NAPROX")}
    assert values(spark, ["Grand Total: 5", "Sub Total 5", "Net Payable", "x", None], tables.is_summary_line) == [True, False, True, False, False]


def test_csv_lines_round_as_printf_and_are_null_where_a_column_is(spark):
    rows = spark.createDataFrame([(1, 24.25), (2, 25.75), (3, 25.15), (4, 0.45), (5, -0.04), (6, None), (None, 1.0)], "k long, mean double")
    got = [r["line"] for r in pages.metrics_csv(rows, {"k": "%d", "mean": "%.1f"}).collect()]
    assert got == ["1,24.2", "2,25.8", "3,25.1", "4,0.5", "5,-0.0", None, None]
