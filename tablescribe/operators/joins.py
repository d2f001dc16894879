"""Range, nearest, overlap and similarity joins as hash joins on buckets; the exact condition is checked inside."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescribe.sources.scratch import written


#: Bucket widths: `width` times a power of this, as many as there are levels.
_GROWTH, _LEVELS = 64.0, 6


def _level(lo: Column, hi: Column, width: float) -> Column:
    """The least level at which an interval touches some 65 buckets at most (the last one takes what is longer)."""
    out = F.lit(_LEVELS - 1)
    for k in reversed(range(_LEVELS - 1)):
        out = F.when(hi - lo <= width * _GROWTH ** (k + 1), k).otherwise(out)
    return out


def _bucket(x: Column, level: Column, width: float) -> Column:
    return F.floor(x / (width * F.pow(F.lit(_GROWTH), level)))


def point_keys(at: Column, width: float) -> Column:
    """The bucket (l, b) of a point at every level; none for null."""
    levels = F.array(*[F.lit(k) for k in range(_LEVELS)])
    return F.when(at.isNotNull(), F.transform(levels, lambda k: F.struct(k.alias("l"), _bucket(at, k, width).alias("b"))))


def range_keys(lo: Column, hi: Column, width: float, which: str = "own") -> Column:
    """The buckets (l, b) that an interval touches at its "own" level, at the "coarse" ones above it, or at "all" of these: a
    bounded number however long it is. None where a bound is null or lo is above hi."""
    own = _level(lo, hi, width)
    last = F.lit(_LEVELS - 1)
    coarse = F.when(own < last, F.sequence(own + 1, last)).otherwise(F.array().cast("array<int>"))
    levels = {"own": F.array(own), "coarse": coarse, "all": F.sequence(own, last)}[which]
    at = lambda k: F.transform(F.sequence(_bucket(lo, k, width), _bucket(hi, k, width)), lambda b: F.struct(k.alias("l"), b.alias("b")))
    return F.when(lo <= hi, F.flatten(F.transform(levels, at)))


def meeting_keys(keys: Callable[[str], Column], left: bool) -> Column:
    """Keys of which two intervals (or boxes) share those at which one of them is at its own level: a's own with b's at all
    levels, and a's coarser ones with b's own. Two short ones don't meet in the wide buckets above them."""
    tagged = lambda which, side: F.transform(keys(which), lambda k: F.struct(F.lit(side).alias("t"), k.alias("k")))
    return F.concat(tagged("own", 0), tagged("coarse", 1)) if left else F.concat(tagged("all", 0), tagged("own", 1))


#: Levels of square buckets, each this many times wider than the one below.
_BOX_GROWTH, _BOX_LEVELS = 8.0, 6


def _box_level(box: Sequence[Column], width: float) -> Column:
    longer = F.greatest(box[2] - box[0], box[3] - box[1])
    out = F.lit(_BOX_LEVELS - 1)
    for k in reversed(range(_BOX_LEVELS - 1)):
        out = F.when(longer <= width * _BOX_GROWTH**k, k).otherwise(out)
    return out


def _square(x: Column, level: Column, width: float) -> Column:
    return F.floor(x / (width * F.pow(F.lit(_BOX_GROWTH), level)))


def box_keys(box: Sequence[Column], width: float, which: str = "own") -> Column:
    """The square buckets (l, x, y) that a box (x0, y0, x1, y1) touches at its own level (four at most, unless it is longer than
    the widest), at the coarser ones, or at all. None for null or reversed sides."""
    own, last = _box_level(box, width), F.lit(_BOX_LEVELS - 1)
    coarse = F.when(own < last, F.sequence(own + 1, last)).otherwise(F.array().cast("array<int>"))
    levels = {"own": F.array(own), "coarse": coarse, "all": F.sequence(own, last)}[which]
    side = lambda lo, hi, k: F.sequence(_square(lo, k, width), _square(hi, k, width))
    at = lambda k: F.flatten(F.transform(side(box[0], box[2], k), lambda x: F.transform(side(box[1], box[3], k), lambda y: F.struct(k.alias("l"), x.alias("x"), y.alias("y")))))
    return F.when((box[0] <= box[2]) & (box[1] <= box[3]), F.flatten(F.transform(levels, at)))


def point_squares(x: Column, y: Column, width: float) -> Column:
    """The square bucket (l, x, y) of a point at every level; none for null."""
    levels = F.array(*[F.lit(k) for k in range(_BOX_LEVELS)])
    return F.when(x.isNotNull() & y.isNotNull(), F.transform(levels, lambda k: F.struct(k.alias("l"), _square(x, k, width).alias("x"), _square(y, k, width).alias("y"))))


def square_level(box: Sequence[Column], width: float) -> Column:
    """The own level of a box and the width of its squares (l, w)."""
    level = _box_level(box, width)
    return F.struct(level.alias("l"), (width * F.pow(F.lit(_BOX_GROWTH), level)).alias("w"))


def meeting_square(a: Sequence[Column], b: Sequence[Column], a_level: Column, b_level: Column, key: Column) -> Column:
    """Whether key is the one square in which two boxes that overlap are to be reported; their levels are worked out before the join."""
    width = F.greatest(a_level["w"], b_level["w"])
    corner = [F.floor(F.greatest(a[i], b[i]) / width) for i in (0, 1)]
    return (key["l"] == F.greatest(a_level["l"], b_level["l"])) & (key["x"] == corner[0]) & (key["y"] == corner[1])


def meeting_bucket(a: tuple[Column, Column], b: tuple[Column, Column], key: Column, width: float) -> Column:
    """Whether key is the one bucket in which a pair of intervals that overlap is to be reported: at the coarser of their
    levels, where the later one starts."""
    level = F.greatest(_level(*a, width), _level(*b, width))
    return (key["l"] == level) & (key["b"] == _bucket(F.greatest(a[0], b[0]), level, width))


def sorted_side(df: DataFrame) -> DataFrame:
    """df as one side of a join that sorts and merges, whatever size Spark takes it for. A table that few compressed bytes hold, or
    whose rows an explode multiplies, is taken for small and would be sent whole to the driver and to every executor."""
    return df.hint("merge")


def _free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def points_in_ranges(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, width: float, by: list[str] = ()) -> DataFrame:
    """Pairs with lo <= at <= hi; null points and bounds, and ranges with lo above hi, meet nothing. No pair comes up twice;
    pick `width` near a usual range: longer ones go to wider buckets."""
    k = _free("__k", points, ranges)
    p = points.withColumn(k, F.explode(point_keys(F.col(at), width)))
    r = ranges.withColumn(k, F.explode(range_keys(F.col(lo), F.col(hi), width)))
    return p.join(r, [k, *by]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop(k)


def overlaps(a: DataFrame, b: DataFrame, by: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of half-open intervals that overlap, each once; empty, reversed and null intervals overlap nothing."""
    k = _free("__k", a, b)
    x = a.withColumn(k, F.explode(meeting_keys(lambda which: range_keys(*map(F.col, a_range), width, which), True)))
    y = b.withColumn(k, F.explode(meeting_keys(lambda which: range_keys(*map(F.col, b_range), width, which), False)))
    meet = (F.col(a_range[0]) < F.col(b_range[1])) & (F.col(b_range[0]) < F.col(a_range[1])) & (F.col(a_range[0]) < F.col(a_range[1])) & (F.col(b_range[0]) < F.col(b_range[1]))
    once = meeting_bucket(tuple(map(F.col, a_range)), tuple(map(F.col, b_range)), F.col(k)["k"], width)
    return x.join(y, [*by, k]).where(meet & once).drop(k)


def anti_union(a: DataFrame, b: DataFrame, by: list[str], lo: str, hi: str, width: float) -> DataFrame:
    """b and the rows of a that overlap none of it (same columns; intervals half-open; empty, reversed and null ones overlap
    nothing, so they stay). Repeated rows of a stay as often as they stand there."""
    k, row, low, high = (_free(n, a, b) for n in ("__k", "__row", "__lo", "__hi"))
    whole = F.struct(*[F.col(f"`{c}`") for c in a.columns])
    y = b.select(*by, F.col(lo).alias(low), F.col(hi).alias(high)).withColumn(k, F.explode(meeting_keys(lambda which: range_keys(F.col(low), F.col(high), width, which), False)))
    tagged = a.withColumn(row, whole).withColumn(k, F.explode(meeting_keys(lambda which: range_keys(F.col(lo), F.col(hi), width, which), True)))
    meet = (F.col(lo) < F.col(high)) & (F.col(low) < F.col(hi)) & (F.col(lo) < F.col(hi)) & (F.col(low) < F.col(high))
    met = tagged.join(y, [*by, k]).where(meet).select(F.col(row).alias("__met")).distinct()
    rest = a.withColumn(row, whole).join(met, F.col(row) == F.col("__met"), "left_anti").select(*a.columns)
    return b.select(*a.columns).unionAll(rest)


def nearest(points: DataFrame, at: str, centres: list[float], reject: float) -> DataFrame:
    """points with the index of the nearest centre (the first of equals), null beyond `reject`."""
    distance = F.array(*[F.struct(F.abs(F.col(at) - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    best = F.array_min(distance)
    return points.withColumn("nearest", F.when(best["d"] <= reject, best["i"]))


def _pieces(word: str, most: int, probe: bool) -> Column:
    """Keys (n, i, piece) of which two words within `most` edits share one, one of them as a probe.

    A word of n letters is cut into most + 1 pieces; `most` edits leave one of them as it is, moved by `most` at most.
    """
    n = F.length(word)
    numbers = lambda lo, hi: F.array(*[F.lit(i) for i in range(lo, hi + 1)])
    start = lambda size, i: F.floor(size * i / (most + 1)).cast("int")

    def key(size: Column, i: Column, move: Column) -> Column:
        width = start(size, i + 1) - start(size, i)
        at = start(size, i) + move
        inside = (size >= 0) & (at >= 0) & (at + width <= n)
        return F.when(inside, F.struct(size.alias("n"), i.alias("i"), F.substring(F.col(word), at + 1, width).alias("piece")))

    if not probe:
        return F.transform(numbers(0, most), lambda i: key(n, i, F.lit(0)))
    moved = lambda d: F.flatten(F.transform(numbers(0, most), lambda i: F.transform(numbers(-most, most), lambda m: key(n + d, i, m))))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(numbers(-most, most), moved))))


def nearest_word(words: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """words (word) with the vocabulary word within `most` edits, itself left out: fewest edits, then the smaller.

    Nulls have no nearest word. The whole vocabulary is compared, by pieces that words within `most` edits share.
    """
    w = words.select("word").distinct().select("word", F.inline(_pieces("word", most, True)))
    v = vocabulary.select(F.col("word").alias("other")).distinct().select("other", F.inline(_pieces("other", most, False)))
    pairs = w.join(v, ["n", "i", "piece"]).where(F.col("word") != F.col("other"))
    pairs = pairs.select("word", "other").distinct().withColumn("edits", F.levenshtein("word", "other", most)).where("edits >= 0")
    return pairs.groupBy("word").agg(F.min(F.struct("edits", "other")).alias("b")).select("word", F.col("b.other").alias("nearest"), F.col("b.edits").alias("edits"))


def words_within(words: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """(word, other, edits): all pairs of distinct words (word) and (other) within `most` edits, equal ones included."""
    w = words.where("word is not null").select("word").distinct().select("word", F.inline(_pieces("word", most, True)))
    v = others.where("other is not null").select("other").distinct().select("other", F.inline(_pieces("other", most, False)))
    pairs = w.join(v, ["n", "i", "piece"]).select("word", "other").distinct()
    return pairs.withColumn("edits", F.levenshtein("word", "other", most)).where("edits >= 0")


def vocabulary_share(docs: DataFrame, id_col: str, words: Column, vocabulary: DataFrame) -> DataFrame:
    """Distinct words of each document and how many of them are in the vocabulary (word)."""
    each = docs.select(id_col, F.explode(F.array_distinct(words)).alias("word"))
    known = each.join(vocabulary.select("word").distinct().withColumn("__v", F.lit(1)), "word", "left")
    return known.groupBy(id_col).agg(F.count("*").alias("words"), F.count("__v").alias("known"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 where one of them is zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def ratio_matches(vectors: DataFrame, by: list[str], id_col: str, vector: str, ratio: float) -> DataFrame:
    """(id, other, cosine): the nearest other vector of a group, where its distance is at most `ratio` times the second's.

    Groups (by) bound the pairs compared; the two nearest of every block of a group are written, and the nearest two of these taken.
    """
    from tablescribe.operators.vectors import nearest_two

    pairs = written(nearest_two(vectors, by, id_col, vector, 2e-9))
    near = pairs.select("id", F.struct(F.when(F.isnan("c"), float("-inf")).otherwise(-F.round("c", 9)).alias("d"), "other", "c").alias("n"))
    best = near.groupBy("id").agg(F.min("n").alias("first"))
    rest = near.join(sorted_side(best), "id").where(F.col("n.other") != F.col("first.other")).groupBy("id", "first").agg(F.min("n").alias("second"))
    clear = F.round(1 - F.col("first.c"), 9) <= ratio * F.round(1 - F.col("second.c"), 9)
    return rest.where(clear).select("id", F.col("first.other").alias("other"), F.round("first.c", 6).alias("cosine"))
