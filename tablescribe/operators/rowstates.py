"""Rules that read a page's rows in order: where the table begins and ends, which rows belong together, which one is the header.

All are windows over one page's rows: what a row-by-row machine would remember is a count, a last value or the first row that
fulfils a condition. Rows are numbered from the top (row); nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.functions import groups
from tablescribe.operators.aggregates import upper_median
from tablescribe.operators.headers import title_words
from tablescribe.operators.series import first_block
from tablescribe.operators.shapes import row_kind


def _ordered(by: Sequence[str]) -> tuple:
    """Windows in order of rows: the plain one, all rows before, all rows up to here."""
    w = Window.partitionBy(*by).orderBy("row")
    return w, w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)


def is_title_row(texts: Column, labels: Column) -> Column:
    """Whether a row's cells are the column titles: no number among them, and of the filled cells three at least and three fifths share
    a word with their column's label, or have one that begins the other from four letters on. Null labels share nothing."""
    near = lambda a, b: (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))
    cells = F.filter(F.arrays_zip(F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit("")))).alias("t"), labels.alias("l")), lambda c: F.coalesce(c["t"], F.lit("")) != "")
    hit = F.size(F.filter(cells, lambda c: F.exists(title_words(c["t"]), lambda a: F.exists(title_words(c["l"]), lambda b: near(a, b)))))
    numbers = F.exists(cells, lambda c: c["t"].rlike(r"^[\d.,%\-()/\s]+$"))
    return ~numbers & (F.size(cells) >= 3) & (hit >= F.greatest(F.lit(3), F.ceil(0.6 * F.size(cells))))


def kinds(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows (by, row, texts, title) with `kind`: group, total, item or '', an item being as full as the rows with a number below the
    first title block are (their upper median)."""
    block = first_block(rows.where("title"), list(by), "row")
    filled = F.size(F.filter("texts", groups.filled))
    below = rows.join(block, list(by)).where((F.col("row") > F.col("end")) & ~F.col("title") & F.array_join("texts", " ").rlike(r"\d")).select(*by, filled.alias("filled"))
    fill = upper_median(below, list(by), "filled").withColumnRenamed("upper_median", "fill")
    joined = rows.join(fill, list(by), "left")
    return joined.select(*rows.columns, row_kind(F.col("texts"), groups.group_name_of(F.col("texts")), F.coalesce("fill", F.lit(0))).alias("kind"))


def table_tops(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, keep_from, title_end, above): the first row of the table on a page whose titles may stand in its middle.

    rows: by, row, title, kind. Above the longest block of title rows (the first of equals) rows that are a group, a total or an item
    stay; a row that is neither stays between two that are, and two of them in a row end the table. Pages without titles keep all rows.
    """
    block = first_block(rows.where("title"), list(by), "row")
    w, _, _ = _ordered(by)
    above = rows.join(block, list(by)).where(F.col("row") < F.col("start"))
    odd = F.col("kind") == ""
    marked = above.withColumn("stop", odd & F.coalesce(F.lead(odd).over(w), F.lit(False)))
    stop = marked.groupBy(*by).agg(F.max(F.when(F.col("stop"), F.col("row"))).alias("stop"))
    kept = marked.drop("stop").join(stop, list(by)).where((F.col("kind") != "") & (F.col("stop").isNull() | (F.col("row") > F.col("stop"))))
    first = kept.groupBy(*by).agg(F.min("row").alias("first"))
    pages = rows.groupBy(*by).agg(F.min("row").alias("top"))
    both = pages.join(block, list(by), "left").join(first, list(by), "left")
    start = F.coalesce("first", "start", "top")
    return both.select(*by, start.alias("keep_from"), F.coalesce("end", F.lit(-1)).alias("title_end"), F.coalesce(F.col("start") - start, F.lit(0)).alias("above"))


def footer_cuts(rows: DataFrame, by: Sequence[str], established: int = 3, ahead: int = 3) -> DataFrame:
    """(by, last, reason): the last row of the table before its footer.

    rows: by, row, tabular, has_first (its first column is filled), filled (columns), keyword (a word of totals). After `established` item
    rows, a tabular row with a keyword, or without its first column and with fewer than 70 % of the columns that item rows fill, cuts
    the table, unless the next `ahead` tabular rows, the first of them two rows on at most, all have their first column. The first such
    row counts; reason is keywords or structure, null if the table goes to the last row.
    """
    _, before, _ = _ordered(by)
    item = F.col("has_first") & ~F.col("keyword")
    # tabular rows only: the rows between them don't count, but for the step to the next one
    t = Window.partitionBy(*by).orderBy("row")
    fill = rows.where("tabular and has_first").groupBy(*by).agg(F.median("filled").alias("fill"))
    seen = rows.where("tabular").withColumns({"seen": F.coalesce(F.sum(item.cast("int")).over(before), F.lit(0)), "step": F.lead("row").over(t) - F.col("row")})
    seen = seen.withColumns({f"next{k}": F.lead("has_first", k).over(t) for k in range(1, ahead + 1)})
    goes_on = F.coalesce(F.col("step") <= 2, F.lit(False))
    for k in range(1, ahead + 1):
        goes_on = goes_on & F.coalesce(F.col(f"next{k}"), F.lit(False))
    sparse = F.coalesce(F.col("filled") < 0.7 * F.col("fill"), F.lit(False))
    cuts = seen.join(fill, list(by), "left").where(~item & (F.col("seen") >= established) & (F.col("keyword") | sparse) & ~goes_on)
    first = cuts.groupBy(*by).agg(F.min(F.struct("row", "keyword")).alias("c"))
    end = rows.groupBy(*by).agg(F.max("row").alias("end"))
    return end.join(first, list(by), "left").select(*by, F.coalesce(F.col("c.row") - 1, F.col("end")).alias("last"), F.when(F.col("c.keyword"), "keywords").when(F.col("c").isNotNull(), "structure").alias("reason"))


def largest_blocks(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, first, last): of the stretches between foreign rows the one with the most tabular rows (the first of equals), from its first
    tabular row to its last.

    rows: by, row, tabular, pieces. A tabular row is foreign if it has fewer than half as many pieces as the median of tabular rows. Pages
    without such a stretch keep all rows.
    """
    _, _, upto = _ordered(by)
    usual = rows.where("tabular").groupBy(*by).agg(F.median("pieces").alias("usual"))
    foreign = F.coalesce(F.col("tabular") & (F.col("pieces") < 0.5 * F.col("usual")), F.lit(False))
    parts = rows.join(usual, list(by), "left").withColumn("foreign", foreign).withColumn("part", F.sum(F.col("foreign").cast("int")).over(upto))
    blocks = parts.where("tabular and not foreign").groupBy(*by, "part").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))
    best = blocks.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "last")).alias("b"))
    ends = rows.groupBy(*by).agg(F.min("row").alias("top"), F.max("row").alias("bottom"))
    return ends.join(best, list(by), "left").select(*by, F.coalesce("b.first", "top").alias("first"), F.coalesce("b.last", "bottom").alias("last"))


def logical_rows(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows (by, row, columns: those it fills) with `logical` (from 1): a row that fills the first column only (0) belongs to the
    logical row before it if that one began with two columns or more."""
    _, before, upto = _ordered(by)
    described = (F.size("columns") == 1) & F.array_contains("columns", 0)
    head = F.last(F.when(~described, F.size("columns") >= 2), ignorenulls=True).over(before)
    starts = ~(described & F.coalesce(head, F.lit(False)))
    return rows.withColumn("starts", starts).withColumn("logical", F.sum(F.col("starts").cast("int")).over(upto)).drop("starts")


def header_rows(rows: DataFrame, by: Sequence[str], first: int = 3) -> DataFrame:
    """(by, header): of the first rows the one that fills the most columns (the earlier of equals), the very first if none fills two."""
    w, _, _ = _ordered(by)
    top = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= first)
    best = top.groupBy(*by).agg(F.min(F.struct((-F.size("columns")).alias("n"), "row")).alias("b"), F.min("row").alias("top"))
    return best.select(*by, F.when(F.col("b.n") <= -2, F.col("b.row")).otherwise(F.col("top")).alias("header"))


def prose_headers(rows: DataFrame, by: Sequence[str], first: int = 3, below: int = 4) -> DataFrame:
    """(by, header): the first of the first rows that is mostly prose above rows of numbers, or with two known titles; null if none is.

    rows: by, row, cells (filled), prose (of them), numeric (of them), titles (of them). Two cells at least, 60 % of them prose, and 30 %
    of the cells of the next four rows numeric or two titles.
    """
    w, _, _ = _ordered(by)
    ahead = w.rowsBetween(1, below)
    seen = rows.withColumns({"nth": F.row_number().over(w), "under": F.sum("cells").over(ahead), "numbers": F.sum("numeric").over(ahead)})
    fits = (F.col("nth") <= first) & (F.col("cells") >= 2) & (F.col("prose") >= 0.6 * F.col("cells")) & (F.coalesce((F.col("under") > 0) & (F.col("numbers") >= 0.3 * F.col("under")), F.lit(False)) | (F.col("titles") >= 2))
    return seen.groupBy(*by).agg(F.min(F.when(fits, F.col("row"))).alias("header"))


def marked_groups(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows (by, row, texts) with `is_group` and `group`: the name of the last group row at or above; null before the first."""
    _, _, upto = _ordered(by)
    name = groups.group_name_of(F.col("texts"))
    return rows.withColumn("name", name).withColumns({"is_group": F.col("name").isNotNull(), "group": F.last("name", ignorenulls=True).over(upto)}).drop("name")
