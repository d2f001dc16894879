"""Pack sizes in document rows ("4X10'S", "30S", "100 ml") as Column expressions; null texts are empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a size, words for pieces, and the words a pack column prints for one pack.
SIZE_UNITS = "ML|MG|MCG|GM|G|KG|L|LTR|IU"
PIECES = "PCS|PC|PIECES|PIECE|TAB|TABS|CAP|CAPS|SACHETS?|STRIPS?"
PACK_WORDS = "VIAL|VIALS|TUBE|TUBES|BOTTLE|BOTTLES|BOT|BOX|BOXES|PCS|PC|PIECE|PIECES|POT|POTS|JAR|JARS|SACHET|SACHETS|STRIP|STRIPS|PACK|PACKS|PACKET|PACKETS|AMP|AMPS|AMPOULE|AMPOULES|CAN|CANS|TIN|TINS|KIT|KITS|SET|SETS|ROLL|ROLLS|PAIR|PAIRS|UNIT|UNITS|EACH|NOS|BAG|BAGS|CARTON|CARTONS|DOZEN|PKT|BTL|CTN"
_DIGIT = "[0-9OoIl|]"
NAME_PACK = rf"(?:^|\s|\()((?:\d{_DIGIT}*\s*[xX×]\s*{_DIGIT}+(?:\s*[xX×]\s*{_DIGIT}+)?\s*['’]?[sS]?)|(?:\d{_DIGIT}*\s*['’][sS])|(?:\d{_DIGIT}*[sS])|(?:\d+\s*pcs)|(?:\d+(?:\.\d+)?\s*(?:ml|gm|g|kg|ltr|l)))\)?\s*$"
NUMBERS = r"^([0-9OoIl|]+)(\s*[xX×]\s*)?([0-9OoIl|]*)(\s*[xX×]\s*)?([0-9OoIl|]*)"


def printed(text: Column) -> Column:
    """Upper case, one kind of apostrophe, no gap inside a number."""
    plain = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[’`´]", "'")
    return F.trim(F.regexp_replace(plain, r"(\d)\s+(?=\d)", "$1"))


def digits_for(text: Column) -> Column:
    """Letters read for digits, and the multiplication sign, in upper-case text."""
    return F.translate(text, "OI|×", "011X")


def unit_count(text: Column) -> Column:
    """Units in a pack: the product of its counts, one for a size or a word."""
    t = digits_for(printed(text))
    number = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("long")
    sized, triple, double = rf"^(\d+)\s*X\s*(\d+(?:\.\d+)?)\s*(?:{SIZE_UNITS})(?:[^A-Z]|$)", r"^(\d+)\s*X\s*(\d+)\s*X\s*(\d+)\s*'?S?\b", r"^(\d+)\s*X\s*(\d+)\s*'?S?\b"
    counted, pieces = r"^(\d+)\s*'?S\b", rf"^(\d+)\s*(?:{PIECES})\b"
    return (
        F.when(t.rlike(sized), number(sized, 1))
        .when(t.rlike(triple), number(triple, 1) * number(triple, 2) * number(triple, 3))
        .when(t.rlike(double), number(double, 1) * number(double, 2))
        .when(t.rlike(counted), number(counted, 1))
        .when(t.rlike(pieces), number(pieces, 1))
        .when(t.rlike(r"^\d+$"), t.try_cast("long"))
        .otherwise(F.lit(1).cast("long"))
    )


def looks_like_pack(text: Column) -> Column:
    t = printed(text)
    d = digits_for(t)
    counts = d.rlike(r"^\d+\s*X\s*\d+") | d.rlike(r"^\d+\s*'?S\b") | t.rlike(r"^\d+\s*(?:PCS|PC|PIECES?|TABS?|CAPS?|SACHETS?|STRIPS?)\b")
    return counts | t.rlike(rf"^\d+(?:\.\d+)?\s*(?:{SIZE_UNITS})\b") | t.rlike(r"^\d+$") | t.rlike(rf"^(?:{PACK_WORDS})$")


def shape_score(text: Column) -> Column:
    """How well a text fits the shape of a pack size, 0 to 5."""
    t = printed(text)
    d = digits_for(t)
    return (
        F.when(d.rlike(r"^\d+\s*X\s*\d+(?:\s*X\s*\d+)?\s*'?S?$"), 5)
        .when(d.rlike(r"^\d+\s*'?S$") | t.rlike(rf"^\d+(?:\.\d+)?\s*(?:{SIZE_UNITS})$"), 4)
        .when(t.rlike(rf"^(?:{PACK_WORDS})$"), 3)
        .when(t.rlike(r"^\d+\s*(?:PCS|PC)$"), 2)
        .when(t.rlike(r"^\d{1,3}$"), 1)
        .otherwise(0)
    )


def pack_at_end(name: Column) -> Column:
    """The pack size that an item name ends with, letters read for digits in its numbers as digits; null if none."""
    found = F.trim(F.regexp_extract(F.coalesce(name, F.lit("")), rf"(?i){NAME_PACK}", 1))
    numbers = F.regexp_extract(found, NUMBERS, 0)
    rest = F.substring(found, F.length(numbers) + 1, F.length(found))
    return F.when(found != "", F.concat(F.translate(numbers, "OoIl|", "00111"), rest))


def repaired_count(text: Column) -> Column:
    """308 or 305 as 30S: an S read as a digit behind a multiple of five, ten or more; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    count = F.regexp_extract(t, r"^(\d{2,4})[58]$", 1)
    return F.when((count != "") & (count.try_cast("int") >= 10) & (count.try_cast("int") % 5 == 0), F.concat(count, F.lit("S")))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[’`´'\s]", "")


def s_confused(chosen: Column, reading: Column) -> Column:
    """Whether reading has an S where chosen ends with an 8 or a 5."""
    a, b = _bare(chosen), _bare(reading)
    same = F.regexp_replace(a, ".$", "") == F.regexp_replace(b, ".$", "")
    return a.rlike(r"^\d+(?:X\d+){0,2}[85]$") & b.rlike(r"^\d+(?:X\d+){0,2}S$") & same


def with_s(text: Column, style: Column) -> Column:
    """The text with its last 8 or 5 written as an S in the given style; null where the shape doesn't allow it."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"(\d)\s+(?=\d)", "$1"), r"^([^X]*?)\s*X\s*", "$1X"))
    eight, five, bare = r"^(\d+X\d+(?:X\d+)?)8$", r"^(\d+X(?:\d+X)?)(\d+)5$", r"^(\d{2,4})[85]$"
    large = F.concat(F.regexp_extract(t, five, 2), F.lit("5")).try_cast("long") > 30
    return (
        F.when(t.rlike(eight), F.concat(F.regexp_extract(t, eight, 1), style))
        .when(t.rlike(five) & large, F.concat(F.regexp_extract(t, five, 1), F.regexp_extract(t, five, 2), style))
        .when(t.rlike(bare), F.concat(F.regexp_extract(t, bare, 1), style))
    )


def ends_with_s(text: Column) -> Column:
    return _bare(text).rlike(r"^\d+(?:X\d+){0,2}S$")
