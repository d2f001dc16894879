"""Numbers in documents: parsing, rounding, closeness, and the class of a token, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns of the formats that are recognised, each as a whole.
CURRENCY = "[$€£¥₹৳]|(?:USD|EUR|GBP|INR|BDT|AUD|CAD|SGD|AED|JPY|Tk|Rs)"
PERCENT = r"^-?\d+(?:[.,]\d+)?\s*%$"
MONEY = r"(?i)^(?:[$€£¥₹৳]|(?:USD|EUR|GBP|INR|BDT|AUD|CAD|SGD|AED|JPY|Tk|Rs))?\s*-?\(?\d{1,3}(?:[ ,]\d{3})*[.,]\d{2}\)?\s*(?:[$€£¥₹৳]|(?:USD|EUR|GBP|INR|BDT|AUD|CAD|SGD|AED|JPY|Tk|Rs))?$"
MONEY_LOOSE = r"(?i)^(?:[$€£¥₹৳]|(?:USD|EUR|GBP|INR|BDT|AUD|CAD|SGD|AED|JPY|Tk|Rs))\s*-?[\d ,.]+$"
DATE = r"(?i)^(?:\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}\s*[-/]?\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*[-/,]?\s*\d{2,4})$"
INT = r"(?i)^-?\d{1,6}(?:\.0+)?\s*(?:pcs|pc|nos|no|units?|box(?:es)?|pkt|kg|gm?|ml|l|ea)?$"
DECIMAL = r"^-?\d+[.,]\d+$"
CODE = r"^[A-Z0-9][A-Z0-9\-_/]{2,}$"
#: Absolute floor of closeness.
FLOOR = 0.011


def stripped(text: Column) -> Column:
    """Without white space at either end: tabs, line ends and no-break spaces too."""
    return F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def token_class(text: Column) -> Column:
    """empty, percent, money, date, int, decimal, code or text: the first whose pattern fits; null counts as empty."""
    t = stripped(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(PERCENT), "percent")
        .when(t.rlike(MONEY) | t.rlike(MONEY_LOOSE), "money")
        .when(t.rlike(DATE), "date")
        .when(t.rlike(INT), "int")
        .when(t.rlike(DECIMAL), "decimal")
        .when(t.rlike(CODE) & t.rlike(r"\d"), "code")
        .otherwise("text")
    )


def parse_number(text: Column) -> Column:
    """A number with either decimal mark; null if it is none.

    The last comma or point is the decimal mark if one or two digits follow it; all others separate thousands.
    Brackets or a leading minus make it negative; currency marks and white space don't count.
    """
    bare = stripped(F.regexp_replace(text, f"(?i){CURRENCY}", ""))
    negative = bare.rlike(r"^\(.*\)$") | bare.startswith("-")
    digits = F.regexp_replace(bare, r"[()\-\s]", "")
    whole, part = F.regexp_extract(digits, r"^(.*)[.,](\d{1,2})$", 1), F.regexp_extract(digits, r"^(.*)[.,](\d{1,2})$", 2)
    plain = F.concat(F.regexp_replace(F.when(part == "", digits).otherwise(whole), "[.,]", ""), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    value = F.when(plain.rlike(r"^\d+(\.\d+)?$|^\.\d+$"), plain.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def round2(x: Column) -> Column:
    """Half up to two decimals, values just below a half counted as it."""
    return F.floor((x + 2.220446049250313e-16) * 100 + 0.5) / 100


def close(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """|a - b| within the floor or the share of the larger."""
    return F.abs(a - b) <= F.greatest(F.lit(FLOOR), tolerance * F.greatest(F.abs(a), F.abs(b)))


def iou(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Intersection over union of half-open boxes."""
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    both = w * h
    return F.try_divide(both, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both)
