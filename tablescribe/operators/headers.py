"""Header rules: which known layout of column titles a printed row of words follows, and where its columns lie.

Words and the rules' title words meet as distinct words, within one or two edits, so the join's size is that of the two
vocabularies. Each title row and rule that share a word then have a sparse matrix of matches; the heaviest common
subsequence of the two word sequences is found in it by a small dynamic programme over many rows and rules at once, and the
rest are expressions on the columns matched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescribe.operators.joins import sorted_side, words_within
from tablescribe.sources.scratch import written

#: Least similarity of two words that match, and the share of a title's weight that has to be found.
LEAST_ALIKE, LEAST_TITLE = 0.75, 0.5


def title_words(text: Column) -> Column:
    """The words of a title: lower case, letters and digits; a percent sign (also read as 0/0 or o/o) is the word pct, dotted
    single letters are one word. Null has none."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b[0o]\s*/\s*[0o6]\b|%", " pct ")
    t = F.regexp_replace(t, r"\b([a-z])\.\s?(?=[a-z]\b)", "$1")
    return F.filter(F.split(t, "[^a-z0-9]+"), lambda w: w != "")


def word_weight(word: Column) -> Column:
    """1 from four letters on, 0.7 for three, else 0.4."""
    return F.when(F.length(word) >= 4, 1.0).when(F.length(word) == 3, 0.7).otherwise(0.4)


def alike(a: Column, b: Column, edits: Column) -> Column:
    """1 for equal words, 1 less the share of edits for one edit in four letters or two in seven, else 0."""
    longer = F.greatest(F.length(a), F.length(b))
    near = ((longer >= 7) & (edits <= 2)) | ((longer >= 4) & (edits <= 1))
    return F.when(a == b, 1.0).when(near, 1 - edits / longer).otherwise(0.0)


def rule_words(rules: DataFrame) -> DataFrame:
    """rules (rule, ci, label) as words in order: rule, i (from 1), ci, word, weight."""
    each = rules.select("rule", "ci", F.posexplode(title_words(F.col("label"))).alias("k", "word"))
    return each.select("rule", F.row_number().over(Window.partitionBy("rule").orderBy("ci", "k")).alias("i"), "ci", "word", word_weight(F.col("word")).alias("weight"))


def page_words(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """words (by, x, text) as title words from left to right: by, j (from 1), word, x. Words at one x go by their text; the same
    word at one x counts once; null places are left out."""
    each = words.where("x is not null").select(*by, "x", "text", F.posexplode(title_words(F.col("text"))).alias("k", "word"))
    once = each.groupBy(*by, "x", "word").agg(F.min(F.struct("text", "k")).alias("first"))
    return once.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("x", "first.text", "first.k")).alias("j"), "word", "x")


def heaviest_chains(row: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which of the matches (row, i, j, value; i and j from 1) make the heaviest common subsequence of each row's two word sequences:
    their rows, i, j and values. Of equally heavy ones that which, from the end, leaves out words of the rule first, then words of the
    page. All rows are worked out together; words without a match change nothing, so sequences may be longer than said here."""
    rows, m, n = int(row.max()) + 1, int(i.max()), int(j.max())
    at = np.zeros((rows, m + 1, n + 1))
    at[row, i, j] = value
    best = np.zeros((rows, m + 1, n + 1))
    for k in range(1, m + 1):
        hit = np.where(at[:, k, 1:] > 0, best[:, k - 1, :-1] + at[:, k, 1:], 0.0)
        best[:, k, 1:] = np.maximum.accumulate(np.maximum(best[:, k - 1, 1:], hit), axis=1)
    out = []
    r, a, b = np.arange(rows), np.full(rows, m), np.full(rows, n)
    while len(r):
        up, left, v = best[r, a - 1, b], best[r, a, b - 1], at[r, a, b]
        take = (v > 0) & (best[r, a - 1, b - 1] + v > np.maximum(up, left))
        out.append((r[take], a[take], b[take], v[take]))
        over = ~take & (left > up)
        a, b = a - ~over, b - (take | over)
        on = (a > 0) & (b > 0)
        r, a, b = r[on], a[on], b[on]
    return tuple(np.concatenate(x) for x in zip(*out))


def heaviest_chain(m: int, n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> list[tuple[int, int, float]]:
    """heaviest_chains for one pair of sequences of m and n words, from the end."""
    return [(int(a), int(b), float(v)) for _, a, b, v in zip(*heaviest_chains(np.zeros(len(i), dtype=int), i, j, value))]


_MATCHES = T.ArrayType(T.StructType([T.StructField("ci", T.LongType()), T.StructField("found", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("js", T.ArrayType(T.IntegerType()))]))
#: Cells of the matrices that are worked out together.
_CELLS = 2_000_000
_COLUMNS = T.ArrayType(T.StructType([T.StructField("x0", T.DoubleType()), T.StructField("x1", T.DoubleType()), T.StructField("from_gutter", T.BooleanType())]))


@F.arrow_udf(_MATCHES)
def _matched(matches: pa.Array) -> pa.Array:
    """The columns of a rule that its chain with a page's words matches, from the matches (i, j, value, ci, least) of each row: ci,
    whether the least weight is reached, the weight, and the places j."""
    sizes = np.diff(np.asarray(matches.offsets))
    flat = {c: matches.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "value", "ci", "least")}
    row = np.repeat(np.arange(len(sizes)), sizes)
    found = [(np.zeros(0, dtype=int),) * 4]
    if len(row):
        step = max(1, _CELLS // int((flat["i"].max() + 1) * (flat["j"].max() + 1)))
        for k in range(0, len(sizes), step):
            of = slice(*np.searchsorted(row, (k, k + step)))
            r, *rest = heaviest_chains(row[of] - k, flat["i"][of], flat["j"][of], flat["value"][of])
            found.append((r + k, *rest))
    r, i, j, value = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((i, r))
    r, i, j, value = r[order], i[order], j[order], value[order]
    # ci and least are those of the rule's word i, in whichever match it stands
    wide = int(flat["i"].max(initial=0)) + 1
    word, at = np.unique(row * wide + flat["i"], return_index=True)
    at = at[np.searchsorted(word, r * wide + i)]
    ci, least = flat["ci"][at], flat["least"][at]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (ci[1:] != ci[:-1])]) if len(r) else np.zeros(0, dtype=int)
    score = np.add.reduceat(value, first) if len(r) else np.zeros(0)
    ends = lambda n: pa.array(n.astype("int32"))
    js = pa.ListArray.from_arrays(ends(np.r_[first, len(r)]), pa.array(j.astype("int32")))
    columns = pa.StructArray.from_arrays([pa.array(ci[first].astype("int64")), pa.array(score >= least[first]), pa.array(score.astype(float)), js], ["ci", "found", "score", "js"])
    return pa.ListArray.from_arrays(ends(np.searchsorted(r[first], np.arange(len(sizes) + 1))), columns)


def aligned_rules(words: DataFrame, rules: DataFrame, by: Sequence[str], least_words: int = 3) -> DataFrame:
    """Every page (by) against every rule with which it shares a word: by, rule, cols (ci, found, x, score of each column matched).

    words: by, x, text of one page's title row (or rows); rules: rule, ci, label. A column is found if half of its title's
    weight matches; x is the mean place of what matches. Pages of fewer than least_words words follow no rule. A page's words
    and a rule's are some tens; pages and rules may be any number. Pages with the same words that some rule has are matched once.
    """
    w, r = page_words(words, by), rule_words(rules)
    seen, known = w.select("word").distinct(), r.select(F.col("word").alias("other")).distinct()
    pairs = written(words_within(seen, known, 2).select("word", "other", alike(F.col("word"), F.col("other"), F.col("edits")).alias("s")).where(F.col("s") >= LEAST_ALIKE))
    # left joins: only the distinct words may be sent to the executors, never the pages' words
    marked = w.join(pairs.select("word").distinct().withColumn("known", F.lit(True)), "word", "left")
    own = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("j", "word", "x"))))
    pages = marked.groupBy(*by).agg(F.count("*").alias("n"), own.alias("own")).where((F.col("n") >= least_words) & (F.size("own") > 0))
    pages = written(pages.select(*by, F.concat_ws(" ", "own.word").alias("words"), F.col("own.x").alias("xs")))
    rows = written(pages.select("words").distinct().withColumn("row", F.monotonically_increasing_id()))
    total = r.groupBy("rule", "ci").agg((F.sum("weight") * LEAST_TITLE).alias("least"))
    of_word = pairs.join(r.withColumnRenamed("word", "other").join(total, ["rule", "ci"]), "other")
    each = rows.select("row", F.posexplode(F.split("words", " ")).alias("at", "word"))
    match = F.struct("i", (F.col("at") + 1).alias("j"), (F.col("s") * F.col("weight")).alias("value"), F.col("ci").cast("long").alias("ci"), "least")
    grouped = each.join(sorted_side(of_word), "word").groupBy("row", "rule").agg(F.collect_list(match).alias("m"))
    matched = grouped.select("row", "rule", _matched("m").alias("m"))
    mean = lambda js: F.aggregate(js, F.lit(0.0), lambda s, j: s + F.element_at("xs", j)) / F.size(js)
    cols = F.transform("m", lambda c: F.struct(c["ci"].cast(dict(rules.dtypes)["ci"]).alias("ci"), c["found"].alias("found"), mean(c["js"]).alias("x"), c["score"].alias("score")))
    return pages.join(sorted_side(rows), "words").join(sorted_side(matched), "row").select(*by, "rule", cols.alias("cols"))


def alignments(words: DataFrame, rules: DataFrame, by: Sequence[str], least_words: int = 3) -> DataFrame:
    """aligned_rules with a row for each column: by, rule, ci, found, x, score."""
    return aligned_rules(words, rules, by, least_words).select(*by, "rule", F.inline("cols"))


def closest_rules(aligned: DataFrame, rules: DataFrame, by: Sequence[str], least_found: int = 3) -> DataFrame:
    """The closest rule of each page from aligned_rules: by, rule, found, total, token_score, in_order, exact.

    The greatest share of columns found wins, then the heavier match, then the smaller rule; three columns are needed.
    in_order: the found columns stand in the rule's order; exact: in order, and all are found.
    """
    total = rules.groupBy("rule").agg(F.countDistinct("ci").alias("total"))
    hits = F.filter("cols", lambda c: c["found"])
    each = aligned.where(F.size(hits) >= least_found).select(*by, "rule", F.transform(F.array_sort(hits), lambda c: c["x"]).alias("xs"), F.aggregate("cols", F.lit(0.0), lambda s, c: s + c["score"]).alias("token_score"))
    pairs = F.zip_with(F.slice("xs", F.lit(1), F.size("xs") - 1), F.slice("xs", F.lit(2), F.size("xs") - 1), lambda a, b: ~(b < a))
    judged = each.select(*by, "rule", F.size("xs").cast("long").alias("found"), "token_score", F.forall(pairs, lambda x: x).alias("in_order")).join(total, "rule", "left")
    first = F.min(F.struct((-F.col("found") / F.col("total")).alias("s"), (-F.round("token_score", 9)).alias("t"), "rule", "found", "total", "token_score", "in_order"))
    best = judged.groupBy(*by).agg(first.alias("b")).select(*by, "b.*")
    return best.select(*by, "rule", "found", "total", "token_score", "in_order", (F.col("in_order") & (F.col("found") == F.col("total"))).alias("exact"))


def best_rules(aligned: DataFrame, rules: DataFrame, by: Sequence[str], least_found: int = 3) -> DataFrame:
    """closest_rules from alignments."""
    return closest_rules(aligned.groupBy(*by, "rule").agg(F.collect_list(F.struct("ci", "found", "x", "score")).alias("cols")), rules, by, least_found)


def boundaries_on_gutters(shares: Sequence[float], x0: float, x1: float, gutters: Sequence[tuple[float, float, bool]], glyph: float) -> list[tuple[float, float, bool]]:
    """Left and right edge of each column of a layout laid over a page, and whether its right boundary is a gutter's.

    shares: the left and the right edge of each column as shares of the width, one after another. Boundaries go from left to right,
    each to the nearest gutter (lo, hi, shallow) that no boundary before has passed and that lies within half of the two columns it
    divides; a shallow one counts as farther away by a fifth of them. Without one the boundary stays at its own place.
    """
    width, narrow = x1 - x0, max(4.0, 0.8 * glyph)
    starts, ends = shares[::2], shares[1::2]
    free = sorted(gutters)
    cuts: list[tuple[float, float, bool]] = []
    before = x0
    for k in range(len(ends) - 1):
        place, span = x0 + ends[k] * width, (ends[k + 1] - starts[k]) * width
        cost = [(abs((lo + hi) / 2 - place) + (0.2 * span if shallow else 0.0), g) for g, (lo, hi, shallow) in enumerate(free) if (lo + hi) / 2 > before + narrow]
        near = min((c for c in cost if c[0] <= 0.5 * span), default=None)
        if near:
            lo, hi, _ = free[near[1]]
            free = free[near[1] + 1 :]
            cuts.append((lo, hi, True))
            before = hi
        else:
            x = max(before + narrow, place)
            cuts.append((x - 1, x + 1, False))
            before = x + 1
    lefts = [x0, *(hi + 1 for _, hi, _ in cuts)]
    rights = [*(lo - 1 for lo, _, _ in cuts), x1]
    return [(a, max(a + 1, b), c) for a, b, c in zip(lefts, rights, [*(c for *_, c in cuts), True])]


@F.pandas_udf(_COLUMNS)
def _laid(shares: pd.Series, x0: pd.Series, x1: pd.Series, gutters: pd.Series, glyph: pd.Series) -> pd.Series:
    return pd.Series([boundaries_on_gutters(list(s), a, b, [(g["lo"], g["hi"], g["shallow"]) for g in gs], h) for s, a, b, gs, h in zip(shares, x0, x1, gutters, glyph)])


def layout_over_pages(layouts: DataFrame, pages: DataFrame, gutters: DataFrame, layout: str, page: str) -> DataFrame:
    """The columns of a layout on each page that takes it: page, ci, x0, x1, from_gutter.

    layouts: layout, ci, x0f, x1f (shares of the width); pages: page, layout, x0, x1, glyph; gutters: page, lo, hi, shallow. A gutter is
    used once. A page's gutters and a layout's columns are some tens. Pages whose layout isn't there are left out.
    """
    in_order = F.sort_array(F.collect_list(F.struct("ci", "x0f", "x1f")))
    shares = layouts.groupBy(layout).agg(F.flatten(F.transform(in_order, lambda c: F.array(c["x0f"], c["x1f"]))).alias("shares"), F.transform(in_order, lambda c: c["ci"]).alias("cis"))
    own = gutters.groupBy(page).agg(F.collect_list(F.struct(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "shallow")).alias("gutters"))
    none = F.array().cast("array<struct<lo:double,hi:double,shallow:boolean>>")
    both = pages.join(shares, layout).join(own, page, "left")
    laid = _laid("shares", F.col("x0").cast("double"), F.col("x1").cast("double"), F.coalesce("gutters", none), F.col("glyph").cast("double"))
    return both.select(page, F.inline(F.arrays_zip(F.col("cis").alias("ci"), laid.alias("c")))).select(page, "ci", "c.*")
