"""Evidence, votes and choices: confidences of tables and cells, readings of several engines, upserts, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"^[-+]?\d[\d,]*(\.\d+)?%?$"


def vote(readings: DataFrame, cell: Sequence[str], text: str, engine: str, score: str, families: Mapping[str, str] | None = None, first: str = "") -> DataFrame:
    """(cell, text, accepted, voices): the reading that most voices give, spelled without case and white space.

    A voice is an engine, or its family where families names one. More voices, then more readings, then the engine
    `first` among them, then the greater sum of scores; with two voices or more the reading is accepted, else the reading of
    the best score stands. Empty readings don't vote. Readings are summed up by spelling before they meet.
    """
    of = F.create_map(*[F.lit(x) for kv in (families or {"": ""}).items() for x in kv])
    voice = F.coalesce(F.element_at(of, F.col(engine)), F.col(engine))
    key = F.regexp_replace(F.lower(F.col(text)), r"\s+", "")
    known = readings.select(*cell, key.alias("__k"), F.col(text).alias("__t"), voice.alias("__v"), F.col(engine).alias("__e"), F.col(score).alias("__s")).where("__k != ''")
    spelled = F.min(F.struct((F.col("__e") != first).alias("o"), F.col("__e").alias("e"), F.col("__t").alias("t")))
    groups = known.groupBy(*cell, "__k").agg(
        F.count_distinct("__v").alias("n"), F.count("*").alias("m"), F.max((F.col("__e") == first).cast("int")).alias("f"), F.round(F.sum("__s"), 6).alias("s"), spelled.alias("p"),
        F.max(F.struct("__s", (F.col("__e") == first).alias("f"), F.col("__t").alias("t"))).alias("b"))
    top = F.max(F.struct("n", "m", "f", "s", F.col("p.t").alias("t")))
    best = groups.groupBy(*cell).agg(top.alias("v"), F.max("b").alias("b"))
    return best.select(*cell, F.when(F.col("v.n") >= 2, F.col("v.t")).otherwise(F.col("b.t")).alias("text"), (F.col("v.n") >= 2).alias("accepted"), F.col("v.n").alias("voices"))


def chosen_text(local: Column, api: Column, local_score: Column, api_score: Column, numeric: Column) -> Column:
    """struct(text, source) of two readings: the same spelling is agreed; a sure service (85) wins; the local reading
    wins where it is as plausible and more than 10 above. In numeric columns only numbers are plausible."""
    a, b = F.coalesce(local, F.lit("")), F.coalesce(api, F.lit(""))
    key = lambda t: F.regexp_replace(F.lower(t), r"\s+", "")
    tidy = lambda t: F.trim(t).rlike(NUMBER)
    pair = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
    cleaner = F.when(numeric & (tidy(a) != tidy(b)), F.when(tidy(a), a).otherwise(b)).when(F.length(b) >= F.length(a), b).otherwise(a)
    plausible = ~numeric | tidy(a) | ~tidy(b)
    return (
        F.when((a == "") & (b == ""), pair(F.lit(""), "empty"))
        .when((b == "") & numeric & ~tidy(a), pair(F.lit(""), "empty"))
        .when(b == "", pair(a, "local"))
        .when(a == "", pair(b, "api"))
        .when(key(a) == key(b), pair(cleaner, "agreed"))
        .when(api_score >= 85, pair(b, "api"))
        .when(plausible & (local_score > api_score + 10), pair(a, "local"))
        .otherwise(pair(b, "api"))
    )


def upsert(rows: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with those of `changes` in place of the ones with their key; null keys are equal to null keys."""
    same = F.lit(True)
    c = changes.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(c, same, "left_anti").unionByName(changes.select(*rows.columns))


def update_where_surer(cells: DataFrame, readings: DataFrame, key: Sequence[str], text: str, score: str) -> DataFrame:
    """cells whose text and score are those of the surest reading, where that is surer than the cell."""
    best = readings.groupBy(*key).agg(F.max(F.struct(F.col(score).alias("s"), F.col(text).alias("t"))).alias("__b"))
    joined = cells.join(best, list(key), "left")
    surer = F.coalesce(F.col("__b.s") > F.coalesce(F.col(score), F.lit(-1.0)), F.lit(False))
    return joined.select(*[F.when(surer, F.col("__b.t")).otherwise(F.col(text)).alias(text) if c == text else F.when(surer, F.col("__b.s")).otherwise(F.col(score)).alias(score) if c == score else F.col(c) for c in cells.columns])


def margin_confidence(scores: DataFrame, by: Sequence[str], score: str, quality: DataFrame, cell: str) -> DataFrame:
    """(by, confidence): 0.6 best + 0.2 min(1, 0.5 + 2.5 margin over the second) + 0.2 mean cell quality (0.5 if none), in 0 .. 1."""
    ranked = scores.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score)))).where("__r <= 2")
    two = ranked.groupBy(*by).agg(F.max(F.when(F.col("__r") == 1, F.col(score))).alias("b"), F.coalesce(F.max(F.when(F.col("__r") == 2, F.col(score))), F.lit(0.0)).alias("s"))
    mean = quality.groupBy(*by).agg(F.avg(cell).alias("q"))
    whole = 0.6 * F.col("b") + 0.2 * F.least(F.lit(1.0), 0.5 + 2.5 * (F.col("b") - F.col("s"))) + 0.2 * F.coalesce("q", F.lit(0.5))
    return two.join(mean, list(by), "left").select(*by, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 4).alias("confidence"))


def semantic_evidence(columns: DataFrame, by: Sequence[str], role: str, confidence: str, ratio: Column) -> DataFrame:
    """(by, evidence): 0.6 mean confidence of the columns with a role + 0.4 their share + 0.15 if the arithmetic ratio is 0.6 or more."""
    known = F.coalesce(F.col(role) != "UNKNOWN", F.lit(False))
    g = columns.groupBy(*by).agg(F.avg(F.when(known, F.col(confidence))).alias("m"), F.avg(known.cast("double")).alias("c"), F.max(ratio).alias("r"))
    whole = 0.6 * F.col("m") + 0.4 * F.col("c") + F.when(F.col("r") >= 0.6, 0.15).otherwise(0.0)
    return g.select(*by, F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)), 6), F.lit(0.0)).alias("evidence"))


def arithmetic_score(checks: DataFrame, by: Sequence[str], status: str) -> DataFrame:
    """(by, score): 0.5 share of evaluated lines that hold + 0.35 share of totals that hold + 0.15 coverage; 0.5 stands for a share
    of nothing. checks: (by, kind line or total, status)."""
    s, line, total = F.col(status), F.col("kind") == "line", F.col("kind") == "total"
    g = checks.groupBy(*by).agg(
        F.count_if(line).alias("items"), F.count_if(line & (s != "unavailable")).alias("e"), F.count_if(line & s.isin("ok", "derived")).alias("k"),
        F.count_if(total & s.isin("ok", "mismatch")).alias("t"), F.count_if(total & (s == "ok")).alias("o"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.5))
    coverage = F.when(F.col("e") > 0, F.least(F.lit(1.0), F.col("e") / F.greatest(F.lit(1), F.col("items")))).otherwise(0.0)
    return g.select(*by, F.round(0.5 * share("k", "e") + 0.35 * share("o", "t") + 0.15 * coverage, 4).alias("score"))


def cell_summary(cells: DataFrame, by: Sequence[str], text: str, confidence: str, bordered: str) -> DataFrame:
    """(by, total, populated, bordered, mean_confidence, low): counts, the mean to 3 digits, and cells below 0.5."""
    return cells.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(F.col(text), F.lit("")) != "").alias("populated"), F.count_if(F.col(bordered)).alias("bordered"),
        F.round(F.avg(confidence), 3).alias("mean_confidence"), F.count_if(F.col(confidence) < 0.5).alias("low"))


def alignment(cells: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """(by, align): left, right or center, whichever edge of a column's cells spreads least; of equals in this order."""
    g = cells.groupBy(*by).agg(F.stddev_pop(left).alias("l"), F.stddev_pop(right).alias("r"), F.stddev_pop((F.col(left) + F.col(right)) / 2).alias("c"))
    least = F.least("l", "r", "c") + 1e-9
    return g.select(*by, F.when(F.col("l") <= least, "left").when(F.col("r") <= least, "right").otherwise("center").alias("align"))


def dominant_type(tokens: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """(by, type, purity, numeric_ratio, empty_ratio): the most frequent kind that isn't empty (of equals the first by name)."""
    counts = tokens.groupBy(*by, kind).agg(F.count("*").alias("__n"))
    real = F.col(kind) != "empty"
    g = counts.groupBy(*by).agg(
        F.min(F.when(real, F.struct((-F.col("__n")).alias("n"), F.col(kind).alias("k")))).alias("b"), F.sum("__n").alias("all"), F.coalesce(F.sum(F.when(real, F.col("__n"))), F.lit(0)).alias("some"),
        F.coalesce(F.sum(F.when(F.col(kind).isin("money", "decimal", "int"), F.col("__n"))), F.lit(0)).alias("num"))
    ratio = lambda a: F.coalesce(F.round(F.try_divide(a, F.col("some")), 6), F.lit(0.0))
    return g.select(*by, F.coalesce(F.col("b.k"), F.lit("empty")).alias("type"), ratio(-F.col("b.n")).alias("purity"), ratio(F.col("num")).alias("numeric_ratio"), F.round((F.col("all") - F.col("some")) / F.col("all"), 6).alias("empty_ratio"))


def within_budget(requests: DataFrame, by: Sequence[str], priority: str, id_col: str, pixels: str, most: int, cap: float, wave: int) -> DataFrame:
    """The requests that a budget takes, with `wave`: by priority, at most `most` of them, one that would pass the cap of
    pixels is skipped and later ones may still fit. A group (a page's requests) is one task's work."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([priority, id_col], ascending=[False, True], kind="stable")
        spent, rows = 0.0, []
        for i, px in enumerate(pdf[pixels]):
            if len(rows) < most and spent + px <= cap:
                spent += px
                rows.append(i)
        return pdf.iloc[rows].assign(wave=[k // wave for k in range(len(rows))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", wave int"
    return requests.groupBy(*by).applyInPandas(take, schema)


def nearest_centroid(vectors: DataFrame, id_col: str, vector: str, centroids: list[list[float]]) -> DataFrame:
    """(id, cluster, distance): the nearest of a given, short list of centroids by squared distance, of equals the first."""
    apart = lambda c: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.array(*[F.struct(apart(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]))
    return vectors.select(id_col, best.alias("b")).select(id_col, F.col("b.i").alias("cluster"), F.col("b.d").alias("distance"))


def principal_axis(points: DataFrame, by: Sequence[str], x: str, y: str, least_ratio: float) -> DataFrame:
    """(by, angle, ratio, elongated): direction in degrees of the greatest spread of the points and how it compares with the
    least, from second moments."""
    g = points.groupBy(*by).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("c"), F.covar_pop(x, y).alias("b"))
    root = F.sqrt((F.col("a") - F.col("c")) ** 2 / 4 + F.col("b") ** 2)
    mean = (F.col("a") + F.col("c")) / 2
    ratio = (mean + root) / F.greatest(mean - root, F.lit(1e-9))
    angle = F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2)
    return g.select(*by, F.round(angle, 4).alias("angle"), F.round(ratio, 4).alias("ratio"), (ratio >= least_ratio).alias("elongated"))


def page_slope(points: DataFrame, page: Sequence[str], piece: str, x: str, y: str) -> DataFrame:
    """(page, slope): the weighted median of the regression slopes of a page's pieces, each by the width it covers."""
    fits = points.groupBy(*page, piece).agg(F.regr_slope(F.col(y), F.col(x)).alias("s"), (F.max(x) - F.min(x)).alias("w")).where("s is not null and w > 0")
    w = Window.partitionBy(*page)
    reached = fits.withColumn("c", F.sum("w").over(w.orderBy("s"))).withColumn("t", F.sum("w").over(w))
    return reached.where("c >= t / 2").groupBy(*page).agg(F.round(F.min("s"), 6).alias("slope"))
