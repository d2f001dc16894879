"""Group names, totals and titles among the rows of a printed table, as Column expressions over arrays of cell texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescribe.functions.names import DESCRIPTORS, FORM_WORDS, QUALIFIERS

# Words that make a row a total or a footer, words of packs and qualifiers, and what a name is made of.
NOT_GROUP = r"(?i)\b(sub\s*total|grand\s*total|total|amount|net\s*payable|payable|round(ed)?|discount|less|in\s*words|carried|brought|forward|continued|page|signature|prepared|authori[sz]ed|received|warranty|remarks?)\b"
TOTAL_WORD = r"(?i)\b(sub\s*-?\s*total|grand\s*total|total)\b"
NUMBERED = r"^([0-9OoIl|SsBbZz]{1,3})\s*[-.:)]?\s+([A-Za-z][A-Za-z &/\-']{3,})$"
NAME = r"^[A-Za-z&\-/.,'’()\s]+$"
NUMBER = r"^[\s(]*[-+]?[\d,]*\.?\d+\s*%?[)\s]*$"
PACK_WORDS = ("PCS", "PC", "PIECES", "VIAL", "VIALS", "TUBE", "BOTTLE", "BOT", "STRIP", "STRIPS", "BOX", "PACK", "POT", "JAR", "SACHET", "SACHETS", "AMP", "AMPOULE")
NOT_CATEGORY = (*PACK_WORDS, "TABS", "TAB", "CAPS", "CAP", "PIECE", "AMPS", "TUBES", "BOXES", "PACKS", "DOSE", "DOSES", "UNIT", "UNITS", "NOS", "EACH")
#: Words that alone don't make a group: the tail of a wrapped item name.
FRAGMENTS = tuple(dict.fromkeys((*FORM_WORDS, *DESCRIPTORS, *PACK_WORDS, *QUALIFIERS)))
#: Sources of a cell that make its text sure.
SURE = ("agreed", "vote", "api", "manual", "name")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def upper_words(text: Column) -> Column:
    return F.filter(F.split(F.upper(text), "[^A-Z]+"), lambda w: w != "")


def filled(text: Column) -> Column:
    return squeezed(text) != ""


def is_number(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NUMBER)


def is_numbered_category(text: Column) -> Column:
    """A number of up to three digits (or letters read for them) and a heading that is no pack word and no total."""
    t = squeezed(text)
    number, rest = F.regexp_extract(t, NUMBERED, 1), F.trim(F.regexp_extract(t, NUMBERED, 2))
    words = upper_words(rest)
    return t.rlike(NUMBERED) & (number.rlike(r"\d") | number.rlike("(?i)^[OS]{1,2}$")) & ~rest.rlike(NOT_GROUP) & (F.size(words) > 0) & ~F.coalesce(F.get(words, F.lit(0)).isin(*NOT_CATEGORY), F.lit(False))


def category_name(text: Column) -> Column:
    """A numbered category with its number in digits."""
    t = squeezed(text)
    digits = F.translate(F.regexp_extract(t, NUMBERED, 1), "OoIl|SsBbZz", "00111558822")
    return F.when(t.rlike(NUMBERED), F.concat_ws(" ", digits, F.trim(F.regexp_extract(t, NUMBERED, 2)))).otherwise(t)


def is_group_name(text: Column, fragments: tuple[str, ...] = FRAGMENTS) -> Column:
    """Letters only, no total word, and more than forms, packs and qualifiers (fragments); or a numbered category."""
    t = squeezed(text)
    words = upper_words(t)
    plain = ~t.rlike(r"\d") & t.rlike(NAME) & (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 2) & ~t.rlike(NOT_GROUP)
    return is_numbered_category(t) | (plain & F.exists(words, lambda w: ~w.isin(*fragments)))


def is_stray(text: Column, source: Column) -> Column:
    """A mark of four characters at most without two letters in a row, unless its source is sure; empty texts too."""
    s = F.trim(F.coalesce(text, F.lit("")))
    return (s == "") | ((F.length(s) <= 4) & ~F.coalesce(source.isin(*SURE), F.lit(False)) & ~s.rlike("[A-Za-z]{2}"))


def group_name_of(texts: Column, fragments: tuple[str, ...] = FRAGMENTS) -> Column:
    """The group name in a row of cells: it starts in the leftmost filled cell, has three cells at most, and every other
    filled cell is a stray; null otherwise. Neighbouring cells are joined by a space, others by a middle dot."""
    places = F.filter(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: filled(F.get(texts, i)))
    cells = F.filter(places, lambda i: is_group_name(F.get(texts, i), fragments))
    stray = F.forall(places, lambda i: F.array_contains(cells, i) | is_stray(F.get(texts, i), F.lit(None).cast("string")))
    joined = F.aggregate(
        cells, F.struct(F.lit("").alias("text"), F.lit(-9).alias("last")),
        lambda a, i: F.struct(F.concat(a["text"], F.when(a["text"] == "", "").when(i == a["last"] + 1, " ").otherwise(" · "), F.trim(F.get(texts, i))).alias("text"), i.alias("last")), lambda a: a["text"],
    )
    right = (F.size(texts) > 0) & (F.size(cells) > 0) & (F.size(cells) <= 3) & (F.get(cells, F.lit(0)) == F.get(places, F.lit(0))) & stray
    return F.when(right & is_group_name(F.replace(joined, F.lit(" · "), F.lit(" ")), fragments), joined)


def inside_total(texts: Column, fragments: tuple[str, ...] = FRAGMENTS) -> Column:
    """The group name left of the first cell with a total word; null if there is none."""
    at = F.array_position(F.transform(texts, lambda t: F.coalesce(t, F.lit("")).rlike(TOTAL_WORD)), True)
    lead = F.slice(texts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))
    return F.when(at > 1, group_name_of(lead, fragments))
