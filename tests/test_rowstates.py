import random

from pyspark.sql import functions as F

from tablescribe.operators import rowstates

wide = lambda *c: [*c, *[""] * (12 - len(c))]
TITLES = wide("Sl.No", "Product", "Product Name", "Pack Size", "Batch", "TP(TK)", "VAT(TK)", "Invoice", "Bonus", "TP(TK)", "VAT(TK)", "Total")
SECOND = wide("", "Code", "", "", "Number", "PACK", "/PACK", "Qty.", "Qty.", "Value", "Value", "Value")
MIDDLE = [
    wide("", "Dhaka Sales Depot", "", "", "", "Customer Code :0010078908", "", "", "Date", "", "", ":05.03.2020"), wide("", "Bangladesh", "", "", "", "", "", "", "Delivered Date", "", "", ":05.03.2020"),
    wide("116", "18000254", "Silinor M Tablet", "1X3X8", "1904502", "395.80", "68.87", "1", "", "395.80", "68.87", "464.67"), wide("", "", "50/1000mg"),
    wide("117", "18000255", "Silinor M Tablet 50/500 mg", "1X3X7", "2000304", "314.84", "54.78", "1", "", "314.84", "54.78", "369.62"),
    wide("", "", "", "", "", "", "SubTotal :", "38", "", "11,049.52", "1,922.55", "12,972.07"), wide("", "Visionary Product", "", "", "MD AFZAL HOSSAIN"), TITLES, SECOND,
    wide("122", "18000117", "Gemicin Tablet 320mg", "1X1X7", "1901163", "341.08", "59.35", "2", "", "682.16", "118.70", "800.86"), wide("125", "18000281", "Temovate Ointment 10gm", "1X1X1", "1904898", "50.97", "8.87", "1", "", "50.97", "8.87", "59.84"),
    wide("", "", "", "", "", "", "SubTotal :", "9", "", "1,793.87", "312.12", "2,105.99"),
]
FOURTH = [
    wide("", "Dhaka Sales Depot", "", "", "", "Customer Code :0010078908", "", "", "Date", "", "", ":05.03.2020"), wide("", "", "", "", "", "", "SubTotal :", "156", "", "43,090.25", "7,497.71", "50,587.96"), wide("", "MSD Product"), TITLES, SECOND,
    wide("93", "20000002", "Andriol TestoCaps 40mg", "", "HPLR0114", "593.64", "", "3", "", "1,780.92", "", "1,780.92"), wide("", "", "", "", "99"), wide("", "", "", "", "", "", "SubTotal :", "3", "", "1,780.92", "", "1,780.92"), wide("", "Credence Product", "", "", "MAHFUZUR RAHMAN JAYED"), TITLES, SECOND,
    wide("94", "18000002", "Acecard Tablet 2.5mg", "1X3X10", "1904369", "112.44", "19.57", "1", "", "112.44", "19.57", "132.01"),
]
PAGES = {"middle": (MIDDLE, {7, 8}), "fourth": (FOURTH, {3, 4, 9, 10}), "top": ([wide("", "Dhaka Sales Depot", "", "", "", "Customer Code :0010078908"), TITLES, SECOND, MIDDLE[2]], {1, 2}), "group": ([wide("", "Rx Product", "", "", "MD JAKARIA HABIB"), TITLES, SECOND, MIDDLE[2]], {1, 2}), "none": ([MIDDLE[2], MIDDLE[4]], set())}


def test_tops_of_known_pages(spark):
    rows = [(page, k, texts, k in titles) for page, (own, titles) in PAGES.items() for k, texts in enumerate(own)]
    marked = rowstates.kinds(spark.createDataFrame(rows, "page string, row int, texts array<string>, title boolean"), ["page"]).cache()
    got = {(r["page"], r["row"]): r["kind"] for r in marked.where("not title").collect()}
    assert [got["middle", k] for k in range(7)] == ["", "", "item", "", "item", "total", "group"]
    tops = {r["page"]: (r["keep_from"], r["title_end"], r["above"]) for r in rowstates.table_tops(marked, ["page"]).collect()}
    assert tops == {"middle": (2, 8, 5), "fourth": (1, 4, 2), "top": (1, 2, 0), "group": (0, 2, 1), "none": (0, -1, 0)}
    groups = {(r["page"], r["row"]): r["group"] for r in rowstates.marked_groups(marked, ["page"]).collect()}
    assert groups["fourth", 1] is None and groups["fourth", 5].startswith("MSD Product") and groups["fourth", 11].startswith("Credence Product")


def test_repeated_title_rows(spark):
    labels = ["Sl.No", "Product Code", "Product Name", "Pack Size", "Batch Number", "TP(TK)", None]
    cases = [(["Sl.No", "Product", "Product Name", "Pack Size", "Batch", "", ""], True), (["", "Code", "", "", "Number", "TP", "x"], True), (["1", "Product", "Name", "Pack", "Batch", "", ""], False), (["Sl", "Product", "", "", "", "", ""], False), (["", "Alpha", "Beta", "Pack", "Gamma", "", ""], False), ([], False), ([None] * 7, False)]
    got = spark.createDataFrame([(i, t, labels) for i, (t, _) in enumerate(cases)], "i int, t array<string>, l array<string>").select("i", rowstates.is_title_row(F.col("t"), F.col("l")).alias("r")).collect()
    assert [bool(r["r"]) for r in sorted(got)] == [w for _, w in cases]


def footer(rows):
    """Row by row with a look ahead."""
    items = sorted(r["filled"] for r in rows if r["tabular"] and r["has_first"])
    n = len(items)
    fill = 0 if not n else items[n // 2] if n % 2 else (items[n // 2 - 1] + items[n // 2]) / 2

    def goes_on(k):
        j, skipped, n = k + 1, 0, 0
        while j < len(rows) and not rows[j]["tabular"]:
            j, skipped = j + 1, skipped + 1
            if skipped > 1:
                return False
        for r in rows[j:]:
            if r["tabular"]:
                if not r["has_first"]:
                    return False
                n += 1
                if n == 3:
                    return True
        return False

    seen = 0
    for k, r in enumerate(rows):
        if not r["tabular"]:
            continue
        if r["has_first"] and not r["keyword"]:
            seen += 1
        elif seen >= 3 and (r["keyword"] or r["filled"] < 0.7 * fill) and not goes_on(k):
            return k - 1, "keywords" if r["keyword"] else "structure"
    return len(rows) - 1, None


def logical(rows):
    out, full = [], None
    for r in rows:
        if set(r["columns"]) == {0} and full:
            out.append(out[-1])
        else:
            out.append(out[-1] + 1 if out else 1)
            full = len(r["columns"]) >= 2
    return out


def test_row_machines_against_loops(spark):
    r = random.Random(7)
    pages = {p: [{"tabular": r.random() < 0.8, "has_first": r.random() < 0.7, "filled": r.randint(0, 6), "keyword": r.random() < 0.1, "columns": sorted(r.sample(range(4), r.choice([0, 1, 1, 1, 2, 3])))} for _ in range(r.randint(1, 25))] for p in range(150)}
    rows = spark.createDataFrame([(p, k, *x.values()) for p, own in pages.items() for k, x in enumerate(own)], "page int, row int, tabular boolean, has_first boolean, filled int, keyword boolean, columns array<int>").cache()
    assert {x["page"]: (x["last"], x["reason"]) for x in rowstates.footer_cuts(rows, ["page"]).collect()} == {p: footer(own) for p, own in pages.items()}
    got = {(x["page"], x["row"]): x["logical"] for x in rowstates.logical_rows(rows, ["page"]).collect()}
    assert got == {(p, k): n for p, own in pages.items() for k, n in enumerate(logical(own))}
