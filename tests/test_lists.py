"""Texts whose reading is known: packs, group names, lines that close a document."""

import pytest
from pyspark.sql import functions as F

from tablescribe.functions import groups, packs
from tablescribe.operators import series, tables

UNITS = {"4X10'S": 40, "1X1'S": 1, "4X1 0S": 40, "5X10s": 50, "10x10's": 100, "30's": 30, "30S": 30, "30 PCS": 30, "1x15gm": 1, "100ml": 1, "5 ML": 1, "1X100ML": 1, "VIAL": 1, "": 1, "2X100ML": 2, "1O0's": 100, "3 X 10'S": 30, "1X3X10": 30, "2X3X10'S": 60, "IXIXIO": 10, "IX3XIO": 30, "20X7": 140, "1X20X7": 140}
LOOKS = {"4X10'S": True, "30S": True, "100ml": True, "VIAL": True, "30": True, "": False, "|": False, "-": False, "S": False, "1": True, "1X1X1": True, "IXIXI": True, "pixxr": False, "ROLL": True, "carton": True, "DOZEN": True, "Nos": True, "PKT": True, "each": True, "bolt": False, None: False}
SHAPES = {"1X1X1": 5, "1X3X10": 5, "IXIXIO": 5, "pixxr": 0, "rxxsio": 0, "ioxxa": 0, "5X6'S": 5, "30S": 4, "308": 1, "|": 0, "BAGS": 3, "CTN": 3}
AT_END = {"Adovas Syp 200ml": "200ml", "Napa Tab 10x10's": "10x10's", "Seclo Cap 30's": "30's", "Fexo 120 Tab 50s": "50s", "Cef-3 200 Cap": None, "SECLO 20MG Capsule": None, "Ansulin 30/70 100 Inj": None, "Halobet 0.05% Crm 20g": "20g", "MICROGEST 200MG CAPS 3XI0'S": "3X10'S", "NEUROBEST FC TAB 6XI0'S": "6X10'S", "Napa Tab 1OS": "10S", "Deltasone 10mg Tab": None, "Napa Tab 1x3x10's": "1x3x10's", "Seclo Cap 1X2X1O": "1X2X10", "OVULETTAB 50MG(1X10'S)": "1X10'S"}
GROUPS = {"RPL": True, "NEVIAN": True, "Square Pharmaceuticals Ltd.": True, "ACME Laboratories": True, "Cosmetics & Toiletries": True, "Non-Pharma": True, "Sub Total": False, "Grand Total": False, "Net Payable": False, "Round Down (-)": False, "Less Discount": False, "Amount In Words": False, "Page": False, "(60s)": False, "500mg/400IU": False, "Tab": False, "Sach": False, "Forte": False, "DS Tab": False, "Vial": False, "Tablet": False, "": False, "-": False, "A": False, "12": False, "Group 1": False, "GOLD": False, "Max Extra": False, "Eye Drops": False, "Junior Syrup": False, "05 INJECTION": True}
CLOSES = ["Total Trade Price 58,373.15", "Total VAT", "Less Discount Amount 1,825.66-", "Net Invoice Amount 66,031.21", "Adjustment Amount : 0.00", "Previous Outstanding Amount : 718,262.80", "Grand Total : 67,446.94", "Total Payable : 66,260.38", "Total Invoice Amount : Taka Sixty Six Thousand", "Amount In Words :Sixty Six"]
GOES_ON = ["SubTotal : 156 43,090.25", "Sub Total", "Total Value", "VAT(TK) Value", "Unit VAT", "Cefotil 750 IM/IV Inj", "TP+VAT", "Total (T.P)", "Total VAT / unit", "Total VAT/pack"]


@pytest.mark.parametrize(
    ("cases", "reading"),
    [(UNITS, packs.unit_count), (LOOKS, packs.looks_like_pack), (SHAPES, packs.shape_score), (AT_END, packs.pack_at_end), (GROUPS, groups.is_group_name), (dict.fromkeys(CLOSES, True) | dict.fromkeys(GOES_ON, False), tables.is_summary_line)],
    ids=["units", "looks", "shapes", "at_end", "groups", "closes"],
)
def test_known_texts(spark, cases, reading):
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", reading(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases


def test_theil_sen_is_the_upper_median_of_all_pairs(spark):
    points = [("a", 0, 0), ("a", 1, 2), ("a", 2, 3), ("a", 3, 9), ("a", 3, 9), ("a", None, 4), ("b", 5, 1), ("b", 5, 2), ("c", 0, 1), ("c", 2, 5)]
    want = {}
    for g in "abc":
        own = [(x, y) for k, x, y in points if k == g and x is not None]
        slopes = sorted((q[1] - p[1]) / (q[0] - p[0]) for i, p in enumerate(own) for q in own[i + 1 :] if q[0] != p[0])
        if slopes:
            s = slopes[len(slopes) // 2]
            want[g] = (s, sorted(y - s * x for x, y in own)[len(own) // 2])
    got = series.theil_sen(spark.createDataFrame(points, "g string, x int, y int"), ["g"], "x", "y").collect()
    assert {r["g"]: (r["slope"], r["offset"]) for r in got} == want
