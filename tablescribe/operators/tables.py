"""Operators on the rows and columns of printed tables, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.functions import groups, packs
from tablescribe.functions.numbers import parse_number

# What names an invoice's total, and spellings of quantity.
SUMMARY_LINE = r"(?i)\b(total\s*trade\s*price|total\s*vat\b(?!\s*/)|less\s*discount|net\s*invoice\s*amount|total\s*invoice\s*amount|grand\s*total|net\s*total|total\s*payable|net\s*payable|amount\s*payable|adjustment\s*amount|(?:previous|total)\s*outstanding|amount\s+in\s+(?:words|figures|tk|taka)|in\s+words|invoice\s*amount\s*:)"
SUB_TOTAL = r"(?i)\bsub\s*-?\s*total\b"
QUANTITY_WORDS = ("qty", "qnt", "qnty", "qtty", "quantity", "quan", "qte", "invqty", "qy")


def is_summary_line(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    first_sub_gone = F.regexp_replace(t, SUB_TOTAL, "")
    return t.rlike(SUMMARY_LINE) & ~(t.rlike(SUB_TOTAL) & ~first_sub_gone.rlike(SUMMARY_LINE))


def packs_by_column(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """rows whose pack texts end with an 8 or a 5 get an S, in the column's style, where at least as many have one."""
    w = Window.partitionBy(*by)
    has_s = packs.ends_with_s(F.col(text))
    marked = rows.withColumns({"__s": has_s, "__c": ~has_s & packs.with_s(F.col(text), F.lit("S")).isNotNull(), "__a": has_s & F.col(text).rlike(r"(?i)['’`´]\s*S\s*$")})
    votes = marked.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{c}_n") for c in ("__s", "__c", "__a")])
    joined = marked.join(votes, by)
    style = F.when(F.col("__a_n") * 2 >= F.col("__s_n"), "'S").otherwise("S")
    new = F.when(F.col("__c") & (F.col("__s_n") >= F.col("__c_n")) & (F.col("__s_n") > 0), packs.with_s(F.col(text), style)).otherwise(F.col(text))
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in rows.columns])


def pack_by_price(rows: DataFrame, id_col: str, text: str, readings: Sequence[str], item: str, unit_price: str, pack_price: str) -> DataFrame:
    """(id, text, by_step) where a pack's price is absurd under its text: the first other reading with an ordinary profit.

    Steps: 1 the S read as a digit, 2 further readings that look like a pack, then the pack its item's name ends with.
    """
    own = F.trim(F.coalesce(F.col(text), F.lit("")))
    steps = [F.col(text), packs.with_s(F.col(text), F.lit("'S")), *[F.when(packs.shape_score(F.col(r)) >= 3, F.trim(F.col(r))) for r in readings], packs.pack_at_end(F.col(item))]
    each = rows.where((F.col(pack_price) > 0) & (F.col(unit_price) > 0)).select(id_col, unit_price, pack_price, own.alias("__own"), F.posexplode(F.array(*steps)).alias("by_step", "__c"))
    each = each.where((F.col("by_step") == 0) | F.col("__c").isNotNull()).withColumn("__u", packs.unit_count(F.col("__c")))
    profit = F.try_divide(F.col(unit_price) * F.col("__u") - F.col(pack_price), F.col(pack_price))
    absurd = F.bool_or((F.col("by_step") == 0) & ((F.col("__p") > 2.0) | (F.col("__p") < -0.4)))
    fine = (F.col("by_step") > 0) & (F.col("__c") != F.col("__own")) & F.col("__p").between(-0.25, 1.2)
    chosen = each.withColumn("__p", profit).groupBy(id_col).agg(absurd.alias("__odd"), F.min(F.when(fine, F.struct("by_step", "__c"))).alias("__b"))
    return chosen.where("__odd and __b is not null").select(id_col, F.col("__b.__c").alias("text"), "__b.by_step")


def numeric_columns(cells: DataFrame, by: list[str], col: str, text: str) -> DataFrame:
    """(by, col, filled, numbers, is_numeric): two filled cells or more, 60 % of them numbers."""
    has = groups.filled(F.col(text))
    counts = cells.groupBy(*by, col).agg(F.count_if(has).alias("filled"), F.count_if(has & groups.is_number(F.col(text))).alias("numbers"))
    return counts.withColumn("is_numeric", (F.col("filled") >= 2) & (F.col("numbers") >= 0.6 * F.col("filled")))


def summary_values(lines: DataFrame, by: list[str], order: str, text: str, words: dict[str, Sequence[str]]) -> DataFrame:
    """(by, key, value): the rightmost number of the line that names a key by its longest word, the first such line.

    A line counts for the first key one of whose words stands before the number. A percentage is no value if the
    line has another number.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    found = F.regexp_extract_all(t, F.lit(r"-?\(?\d[\d ,.]*\)?%?"), F.lit(0))
    last = F.get(found, F.size(found) - 1)
    at = F.length(t) - F.instr(F.reverse(t), F.reverse(last)) - F.length(last) + 1
    before = F.lower(F.left(t, at))
    hits = [F.coalesce(*[F.when(F.contains(before, F.lit(w)), F.struct(F.lit(k).alias("key"), F.lit(len(w)).alias("strength"))) for w in ws]) for k, ws in words.items()]
    usable = (F.size(found) > 0) & ~(last.endswith("%") & (F.size(found) > 1))
    named = lines.where(usable).select(*by, order, F.round(parse_number(last), 2).alias("value"), F.coalesce(*hits).alias("hit")).where("value is not null and hit is not null")
    best = F.min(F.struct((-F.col("hit.strength")).alias("s"), F.col(order).alias("o"), F.col("value").alias("value")))
    return named.groupBy(*by, F.col("hit.key").alias("key")).agg(best.alias("b")).select(*by, "key", "b.value")


def lexicon_scores(texts: DataFrame, by: list[str], text: str, words: dict[str, list[str]], score: Callable[[Column, Column], Column]) -> DataFrame:
    """(by, name, score): for each name of the lexicon the greatest score of its words that a text contains. The lexicon is
    a constant, so texts are neither joined nor shuffled."""
    t = F.col(text)
    best = [F.struct(F.lit(k).alias("name"), F.greatest(*[F.when(F.contains(t, F.lit(w)), score(t, F.lit(w))) for w in [*ws, ws[0]]]).alias("score")) for k, ws in words.items()]
    return texts.select(*by, F.explode(F.array(*best)).alias("s")).where("s.score is not null").select(*by, "s.name", "s.score")


def page_numbers(lines: DataFrame, by: list[str], order: str, text: str, patterns: list[str]) -> DataFrame:
    """(by, page, pages): from the first line, by the first pattern (its groups: page, number of pages), that prints one."""
    t = F.regexp_replace(F.replace(F.col(text), F.lit("|"), F.lit("1")), r"\s+", " ")

    def hit(pattern: str) -> Column:
        page = F.regexp_extract(t, pattern, 1).try_cast("int")
        of = F.regexp_extract(t, pattern, 2).try_cast("int") if pattern.count(r"(\d") > 1 else F.lit(None).cast("int")
        return F.when(t.rlike(r"(?i)p(?:age|g)") & (page >= 1), F.struct(page.alias("page"), F.when(of >= page, of).alias("pages")))

    found = lines.select(*by, order, F.coalesce(*[hit(p) for p in patterns]).alias("hit")).where("hit is not null")
    return found.groupBy(*by).agg(F.min_by("hit", order).alias("hit")).select(*by, "hit.*")


def quantity_column(cells: DataFrame, by: list[str], col: str, order: str, text: str) -> DataFrame:
    """(by, col, median): the column whose numbers read like quantities: whole on 80 % of its filled cells (three or more),
    not mostly zeros or codes of four digits, not counting up by one; of several the one with the least upper median."""
    plain = F.replace(F.col(text), F.lit(","), F.lit(""))
    cells = cells.where(groups.filled(F.col(text))).withColumn("__x", F.when(plain.rlike(r"^\d+$"), plain.try_cast("long")))
    counts = cells.groupBy(*by, col).agg(F.count("*").alias("filled"), F.count("__x").alias("nums"), F.count_if(F.col("__x") == 0).alias("zeros"), F.count_if(F.col(text).rlike(r"^\d{4,}$")).alias("codes"))
    of_col = Window.partitionBy(*by, col)
    numbers = cells.where("__x is not null").withColumn("__step", F.col("__x") - F.lag("__x").over(of_col.orderBy(order)))
    ranked = numbers.withColumn("__r", F.row_number().over(of_col.orderBy("__x")))
    stats = ranked.join(counts, [*by, col]).groupBy(*by, col, "filled", "nums", "zeros", "codes").agg(
        F.count_if(F.col("__step") == 1).alias("steps"), F.max(F.when(F.col("__r") == F.floor(F.col("nums") / 2) + 1, F.col("__x"))).alias("median"))
    fit = "filled >= 3 and nums >= 0.8 * filled and zeros <= 0.5 * nums and codes <= 0.5 * filled and not (nums >= 4 and steps >= 0.8 * (nums - 1)) and median <= 9999"
    return stats.where(fit).groupBy(*by).agg(F.min(F.struct("median", col)).alias("b")).select(*by, F.col(f"b.{col}").alias(col), "b.median")


def is_quantity_word(word: Column) -> Column:
    """A spelling of quantity, one letter off where it has three or more."""
    return F.exists(F.array(*[F.lit(q) for q in QUANTITY_WORDS]), lambda q: (word == q) | ((F.length(word) >= 3) & (F.length(q) >= 3) & (F.levenshtein(word, q) <= 1)))


def keys_of_titles(titles: DataFrame, id_col: str, title: str, vocabulary: list[tuple[str, str]]) -> DataFrame:
    """(id, key, label_words, exact): quantity first; else the key of the longest label all whose words the title has, one
    letter off where they have four or more. label_words and exact: words of the best label, and those met exactly."""
    tokens = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    split = titles.select(id_col, tokens(F.col(title)).alias("__t"))
    t = F.col("__t")

    def one_off(word: str) -> Callable[[Column], Column]:
        return lambda b: F.levenshtein(F.lit(word), b) <= 1

    def label(i: int, key: str, text: str) -> Column:
        words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
        near = [F.array_contains(t, w) | (F.exists(t, one_off(w)) if len(w) >= 4 else F.lit(False)) for w in words]
        every = near[0]
        for n in near[1:]:
            every = every & n
        exact = sum((F.array_contains(t, w).cast("int") for w in words), F.lit(0))
        return F.when(every, F.struct(F.lit(len(words)).alias("n"), exact.alias("exact"), F.lit(-i).alias("first"), F.lit(key).alias("key")))

    fits = F.array_compact(F.array(*[label(i, k, x) for i, (k, x) in enumerate(vocabulary)]))
    longest = F.array_max(F.transform(fits, lambda f: F.struct(f["n"].alias("n"), f["first"].alias("first"), f["key"].alias("key"))))
    agreed = F.array_max(F.transform(fits, lambda f: F.struct(f["n"].alias("n"), f["exact"].alias("exact"))))
    key = F.when(F.exists(t, is_quantity_word), "qty").otherwise(longest["key"])
    return split.select(id_col, key.alias("key"), F.coalesce(agreed["n"], F.lit(0)).alias("label_words"), F.coalesce(agreed["exact"], F.lit(0)).alias("exact"))


def first_match(lines: DataFrame, by: list[str], order: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """(by, value): what the first line that fits one of the patterns has in its first group, by the first pattern that fits."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.coalesce(*[F.when(t.rlike(p), F.trim(F.regexp_extract(t, p, 1))) for p in patterns])
    return lines.select(*by, order, found.alias("v")).where("v is not null").groupBy(*by).agg(F.min_by("v", order).alias("value"))
