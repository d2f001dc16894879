"""Numbers as a recogniser reads them: look-alike letters, misreads, labels of number columns, tolerances of sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_number(text: Column) -> Column:
    """struct(value, percent, clean, norm), null if the text is no number: at most two letters, fewer than digits, read
    as the digits they look like; marks beside it don't count. clean: the text is the number and nothing else."""
    raw = F.trim(text)
    t = F.replace(raw, F.lit("%"), F.lit(""))
    letters, digits = F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.length(F.regexp_replace(t, r"[^0-9]", ""))
    fixed = F.translate(t, "OolI|SBZ", "00111582")
    clean = (fixed == t) & ~t.rlike(r"[^\d.,\-+]") & ~t.endswith(".")
    bare = F.regexp_replace(fixed, r"[^\d.,\-+]", "")
    grouped, comma = bare.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), bare.rlike(r"^-?\d+,\d{1,2}$")
    pointed = F.when(~grouped & comma, F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    # of several points the last one counts, and none at the end
    last = F.regexp_extract(pointed, r"^(.*)\.([^.]*)$", 2)
    whole = F.replace(F.regexp_extract(pointed, r"^(.*)\.([^.]*)$", 1), F.lit("."), F.lit(""))
    norm = F.when(pointed.contains("."), F.when(last == "", whole).otherwise(F.concat(whole, F.lit("."), last))).otherwise(pointed)
    value = F.when(norm.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)$"), norm.try_cast("double"))
    word = (letters > 2) | ((letters > 0) & (letters >= digits))
    return F.when((raw != "") & ~word & value.isNotNull(), F.struct(value.alias("value"), raw.rlike(r"%\s*$").alias("percent"), clean.alias("clean"), norm.alias("norm")))


def fixed_point(value: Column, decimals: Column) -> Column:
    """The value with 0 to 9 decimals as text."""
    scaled = F.round(F.abs(value) * F.pow(F.lit(10.0), decimals)).cast("decimal(38,0)").cast("string")
    padded = F.when(F.length(scaled) > decimals, scaled).otherwise(F.lpad(scaled, 10, "0"))
    whole = F.length(padded) - decimals
    text = F.concat(F.regexp_replace(F.left(padded, whole), r"^0+(?=\d)", ""), F.when(decimals > 0, F.concat(F.lit("."), F.right(padded, decimals))).otherwise(""))
    return F.concat(F.when((value < 0) & text.rlike("[1-9]"), "-").otherwise(""), text)


def format_like(value: Column, text: Column) -> Column:
    """The value with as many decimals as the text has; where it has none, two unless the value is whole."""
    printed = F.regexp_extract(F.coalesce(text, F.lit("")), r"\.(\d+)\s*%?$", 1)
    decimals = F.when(printed != "", F.length(printed)).when(value == F.floor(value), 0).otherwise(2)
    return fixed_point(value, decimals)


def plausible_misread(value: Column, text: Column) -> Column:
    """Whether the text may be the value misread: one digit changed, dropped or added (two of five or more), or the point moved."""
    digits = lambda c: F.regexp_replace(c, r"[^\d]", "")
    ends = lambda c: F.regexp_replace(c, "0+$", "")
    a, b, b2 = digits(F.coalesce(text, F.lit(""))), digits(format_like(value, text)), ends(digits(fixed_point(value, F.lit(2))))
    moved = (ends(a) == b2) & (b2 != "")
    apart = F.levenshtein(a, b)
    return (a != "") & (moved | (apart <= 1) | ((F.length(a) >= 5) & (apart <= 2)))


def role_of_label(label: Column) -> Column:
    """The role that a number column's printed label names; null if none. A trailing ? marks a role to be settled by the numbers."""
    text = F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(label, F.lit(""))), F.lit("%"), F.lit(" pct ")), "[^a-z0-9]+", " "))
    has = lambda words: text.rlike(rf"\b({words})\b")
    money = has("total|value|amount|amt")
    return (
        F.when(has("qty|quantity|inv qty|invoice qty") & ~has("bonus|free|batch|btch"), "qty")
        .when(has("bonus|free|bq|bon us"), "bonus")
        .when(has("mrp"), "mrp")
        .when(has("net|payable|grand"), "net")
        .when(has("disc|discount|dis"), F.when(has("pct"), "discPct").otherwise("disc?"))
        .when(has("vat") & has("tp|trade|price") & text.rlike("plus|per pack"), "unitGross")
        .when(has("gross"), "unitGross")
        .when(has("vat"), F.when(has("pct"), "vatPct").when(money, "totalVat").otherwise("vat?"))
        .when(has("sp"), F.when(money, "totalSp").otherwise("unitSp"))
        .when(has("tp|trade|t price|tprice|price|rate"), F.when(money, "totalTp").otherwise("unitTp"))
        .when(money & has("total"), "net")
    )


def relation_tolerance(target: Column, quantity: Column | None = None, slack: float = 0.0) -> Column:
    """How far the two sides of a relation may lie apart: rounding of printed terms, scaled by the quantity where the
    relation is per unit, and a drift on large amounts."""
    q = F.lit(1.0) if quantity is None else F.when(F.coalesce(quantity, F.lit(0.0)) != 0, F.abs(quantity)).otherwise(1.0)
    return 0.0151 + 0.0051 * q + 0.0006 * F.abs(F.coalesce(target, F.lit(0.0))) + slack
