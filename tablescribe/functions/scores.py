"""Scores of hypotheses, tables, cells, merges and product matches, as Column expressions with fixed weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def hypothesis(line: Column, align: Column, row: Column, column: Column, density: Column, split: Column, missed: Column) -> Column:
    """Five ratios of a grid, less two penalties."""
    base = 0.25 * line + 0.25 * align + 0.2 * row + 0.2 * column + 0.1 * F.least(F.lit(1.0), 1.4 * density)
    return base * (1 - F.least(F.lit(1.0), 2.5 * split)) * (1 - F.least(F.lit(0.6), 0.6 * missed))


def borderless(gutter: Column, pitch_mad: Column, pitch_median: Column, purity: Column, repeat: Column) -> Column:
    """Evidence for a table without rules: clear gutters, an even pitch, pure columns, repeating rows."""
    pitch = F.coalesce(F.greatest(F.lit(0.0), 1 - 2.5 * F.try_divide(pitch_mad, pitch_median)), F.lit(0.0))
    return 0.3 * gutter + 0.25 * pitch + 0.25 * purity + 0.2 * repeat


def fused_cell(geometry: Column, text: Column, bordered: Column, has_text: Column, role: Column, arithmetic_ok: Column) -> Column:
    """Weighted mean of a cell's evidence; what is missing is left out and its weight too."""
    parts = [
        (geometry, 0.28), (text, 0.14), (F.when(bordered, 0.85).when(has_text, 0.6).otherwise(0.5), 0.18),
        (F.when(F.coalesce(role, F.lit("UNKNOWN")) != "UNKNOWN", 0.85).otherwise(0.35), 0.16), (F.when(arithmetic_ok, 0.95).when(~arithmetic_ok, 0.15), 0.24),
    ]
    total = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return total / sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))


def merge_confidence(scores: Sequence[Column], weights: Sequence[float] = (0.25, 0.25, 0.20, 0.15, 0.15)) -> Column:
    """Weighted sum of five scores of a pair of neighbouring pieces: whether they are one."""
    return sum((w * s for w, s in zip(weights, scores)), F.lit(0.0))


def edge_score(colour: Column, area_a: Column, area_b: Column, keypoints: Column) -> Column:
    """Likeness of colour, balance of areas, and keypoints between two nodes (five are enough)."""
    return 0.45 * colour + 0.35 * (2 * F.least(area_a, area_b) / (area_a + area_b)) + 0.2 * F.least(F.lit(1.0), keypoints / 5)


def match_score(factors: Sequence[Column], size_against_solid: Column, maker: Column, price_agrees: Column, pack_agrees: Column, descriptor: Column) -> Column:
    """Product of the factors, halved for a size against a tablet or capsule, then raised by what agrees, 1 at most each time."""
    score = F.when(size_against_solid, 0.5).otherwise(1.0)
    for f in factors:
        score = score * f
    for hit, gain in ((maker, 0.03), (price_agrees, 0.05), (pack_agrees, 0.03), (descriptor, 0.02)):
        score = F.when(hit, F.least(F.lit(1.0), score + gain)).otherwise(score)
    return score


def match_status(score: Column, rival: Column) -> Column:
    """match from 0.85 on without a rival, uncertain from 0.6 on, else none."""
    return F.when((score >= 0.85) & ~rival, "match").when(score >= 0.6, "uncertain").otherwise("none")


def nearest_price(price: Column, purchase: Column, trade: Column, units: Column, own_units: Column) -> Column:
    """struct(rel, nearest, differs): how far an invoice's price is from the nearest of a product's prices, by unit and by pack (the
    invoice's own pack first); it differs beyond 2 %. Null without a price to compare with."""
    own = F.when(own_units > 0, own_units)
    listed = F.filter(F.array(purchase * own, trade * own, purchase, purchase * F.coalesce(units, F.lit(1.0)), trade, trade * F.coalesce(units, F.lit(1.0))), lambda v: v.isNotNull() & (v > 0))
    best = F.array_min(F.transform(listed, lambda v, i: F.struct(F.round(F.abs(price - v) / F.greatest(v, F.lit(0.01)), 9).alias("rel"), i.alias("i"), v.alias("nearest"))))
    return F.when(price.isNotNull() & (F.size(listed) > 0), F.struct(F.round(best["rel"], 3).alias("rel"), best["nearest"].alias("nearest"), (best["rel"] > 0.02).alias("differs")))


def pack_profit(unit_price: Column, units: Column, paid: Column) -> Column:
    """Profit in per cent of a pack at its unit price over what was paid."""
    return F.when(paid > 0, (unit_price * F.coalesce(units, F.lit(1)) - paid) / paid * 100)


def document_type(header: Column) -> Column:
    """CREDIT_NOTE, PROFORMA, TAX_INVOICE, INVOICE or UNKNOWN, by the first that the header names."""
    h = F.lower(F.coalesce(header, F.lit("")))
    return F.when(h.contains("credit note"), "CREDIT_NOTE").when(h.contains("proforma"), "PROFORMA").when(h.contains("tax invoice"), "TAX_INVOICE").when(h.contains("invoice"), "INVOICE").otherwise("UNKNOWN")


def sane_aspect(width: Column, height: Column, least: float = 0.05, most: float = 20.0) -> Column:
    """Whether a box has sides and a ratio of them within the limits."""
    ratio = F.try_divide(width, height)
    return F.coalesce((width > 0) & (height > 0) & (ratio >= least) & (ratio <= most), F.lit(False))
