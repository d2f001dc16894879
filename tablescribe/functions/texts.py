"""Rewrites of recognised texts and the predicates that route them, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def look_alikes(text: Column) -> Column:
    """Digits between letters as the letters they look like, white space squeezed. (Nothing here is left to chance.)"""
    t = F.regexp_replace(text, "0(?=[A-Za-z])", "O")
    t = F.regexp_replace(t, "(?<=[A-Za-z])0", "o")
    t = F.regexp_replace(t, "1(?=[A-Za-z])", "l")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\bI1\b", "Il"), r"\s{2,}", " "))


def capitalised(text: Column) -> Column:
    """White space squeezed, a capital at the start and behind a full stop, exclamation or question mark."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000))
    starts = lambda w, i: (i == 0) | (F.get(words, i - 1).rlike(r"[.!?]$") & w.rlike("^[a-z]"))
    return F.array_join(F.transform(words, lambda w, i: F.when(starts(w, i), capital(w)).otherwise(w)), " ")


def needs_second_reader(width: Column, height: Column, confidence: Column, stroke: Column, handwritten: Column) -> Column:
    """Very wide, unsure, thin or handwritten."""
    return (width / F.greatest(F.lit(1.0), height) > 8) | (confidence < 0.7) | (stroke < 2) | handwritten


def needs_language_model(text: Column, confidence: Column, sure: float) -> Column:
    """Two characters or more, not sure yet, and not only a number."""
    return F.coalesce((F.length(text) >= 2) & (confidence < sure) & ~text.rlike(r"^[\d.,\s%$€£¥]+$"), F.lit(False))


def backbone(width: Column, height: Column, quality: Column, names: tuple[str, str, str]) -> Column:
    """(for large images, for poor ones, else)"""
    return F.when((width > 2000) | (height > 2000), names[0]).when(quality < 0.5, names[1]).otherwise(names[2])


def item_tables(tables: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Of each page the tables with three columns and rows or more, or else the widest, with `rejected`: two of the four
    signs of decoration (decorative rules, a single row, a single column, two filled cells at most)."""
    signs = sum(((c).cast("int") for c in (F.col("decorative"), F.col("n_rows") <= 1, F.col("cols") <= 1, F.col("populated") <= 2)), F.lit(0))
    item = (F.col("cols") >= 3) & (F.col("n_rows") >= 3)
    w = Window.partitionBy(*by)
    ranked = tables.withColumns({"rejected": signs >= 2, "__i": item, "__any": F.max(item).over(w), "__r": F.row_number().over(w.orderBy(F.desc("cols"), F.desc("n_rows"), id_col))})
    return ranked.where("__i or (not __any and __r = 1)").drop("__i", "__any", "__r")
