import pytest
from pyspark.sql import functions as F

from tablescribe.functions import numbers

CLASSES = {"10": "int", "50.00": "money", "$1,250.00": "money", "15%": "percent", "12/03/2026": "date", "Paracetamol": "text", "": "empty", None: "empty", "1234.50": "decimal", "1,234": "decimal", "AB-12": "code", "ABC": "text"}
NUMBERS = {"1,234.56": 1234.56, "1.234,56": 1234.56, "1 234,56": 1234.56, "50.00": 50.0, "1,234": 1234.0, "-45.50": -45.5, "(45.50)": -45.5, "$ 12": 12.0, "1.234": 1234.0, "": None, "abc": None, None: None}


def test_token_classes(spark):
    got = spark.createDataFrame([(k,) for k in CLASSES], "t string").select("t", numbers.token_class(F.col("t"))).collect()
    assert {a: b for a, b in got} == CLASSES


def test_parse_number(spark):
    got = spark.createDataFrame([(k,) for k in NUMBERS], "t string").select("t", numbers.parse_number(F.col("t"))).collect()
    assert {a: b for a, b in got} == NUMBERS


def test_rounding_and_closeness(spark):
    row = spark.range(1).select(
        numbers.half_up(F.lit(-0.5)), numbers.half_up(F.lit(2.5)), numbers.round2(F.lit(1.005)), numbers.close(F.lit(100.0), F.lit(101.9)), numbers.close(F.lit(0.0), F.lit(0.012)),
        numbers.iou(*[F.lit(float(v)) for v in (0, 0, 2, 2, 1, 0, 3, 2)]),
    ).first()
    assert tuple(row)[:2] == (0.0, 3.0) and row[2] == pytest.approx(1.01) and row[3] and not row[4] and row[5] == pytest.approx(1 / 3)
