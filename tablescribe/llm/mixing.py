"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Target words per source come from the weights, no source above `cap` times its own words; the excess
goes to the others by weight until none is above. Words are dealt in equal-token blocks of `block`
words: the blocks of the whole mix are apportioned to the sources by the highest quotients
target / (2 k + 1), and those of a source to its shards (at most about `shard_rows` documents each, by
a seeded hash) by the highest quotients words / (2 k + 1). Within a shard, documents stand in seeded
order, blocks follow each other without regard to documents, and a seeded systematic choice takes the
quota: every block quota // blocks times and the chosen rest once more.

Only shards are ordered, so a hot source is as many tasks as it has shards. Sources and shards have one
row each in the tables that are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.llm.common import WORD, word_count, written


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: parties with a column `quota`, the seats of the party out of its group's `seats`.

    The seats go to the highest quotients votes / (2 k + 1), k = 0, 1, ...; ties to the smaller key, null
    last. With n parties in a group, a party's number of seats is within 1 + n / 2 times its share of the
    votes of its exact claim, because the claims rounded to whole seats miss the total by n / 2 at most; so
    only that range of quotients is laid out, about 3 n rows for n parties. Parties without votes get none.
    """
    of_group = Window.partitionBy(*group)
    p = parties.withColumn("__sum", F.sum(votes).over(of_group)).withColumn("__n", F.count("*").over(of_group))
    claim = F.col(seats) * F.col(votes) / F.col("__sum")
    reach = F.ceil(F.col("__n") / 2 * F.col(votes) / F.col("__sum")) + 1
    ranged = p.where(F.col(votes) > 0).withColumn("__lo", F.greatest(F.lit(0).cast("long"), F.floor(claim) - reach)).withColumn("__hi", F.floor(claim) + reach)
    ranged = ranged.withColumn("__left", F.col(seats) - F.sum("__lo").over(of_group))
    quotients = ranged.withColumn("__k", F.explode(F.sequence("__lo", "__hi"))).withColumn("__q", F.col(votes) / (2 * F.col("__k") + 1))
    rank = F.row_number().over(of_group.orderBy(F.desc("__q"), *[F.asc_nulls_last(k) for k in key], "__k"))
    won = quotients.withColumn("__rank", rank).groupBy(*dict.fromkeys([*group, *key])).agg((F.first("__lo") + F.sum(F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0))).cast("long").alias("quota"))
    names = list(dict.fromkeys([*group, *key]))
    w = won.select(*[F.col(c).alias(f"__w_{c}") for c in names], "quota")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    return parties.join(w, same, "left").drop(*[f"__w_{c}" for c in names]).withColumn("quota", F.coalesce("quota", F.lit(0)))


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) with a column target: the words that the mix should take from each.

    Sources by code point, null last, weigh `weights` in turn. Together the targets are share times all
    words; none is above cap times its source's words, and what that leaves goes to the rest by weight.
    """
    if share > cap:
        raise ValueError("share can't be above cap: no mix has that many words")
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # words per weight if this and the later sources in this order share what the earlier ones at their cap leave
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("full", F.col("most") <= F.col("w") * F.col("level"))
    # the first source below its cap sets the level; the levels after it are lower, so it is the greatest among them
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level).alias("target"))


def _number(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 12), 16, 10).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
    cap: int = 2, block: int = 64, shard_rows: int = 4096, seed: int = 17, whole_rows: bool = False,
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken, and with whole_rows the row of docs as the struct `doc`.

    size: words of the text (null: 0). taken: words that the mix takes from the document, repeats counted,
    at most cap times its size. Further columns tell which blocks: first (the document's first word in its
    shard), shard_words, blocks, whole (times every block is taken), rest (blocks taken once more), offset
    (of the systematic choice). The same input and seed give the same result. Repeated rows count as
    documents of their own. A null source is a source; a null id is an id. Empty texts take no words. An empty
    table gives an empty result. Columns of docs other than those named are ignored.
    """
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string")))
    whole_docs = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] * whole_rows
    of_docs = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), h.alias("h"), *whole_docs)
    sized = written(of_docs.drop("doc"), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    totals = written(totals.withColumn("shards", F.ceil(F.col("rows") / shard_rows)), "sources")
    aims = targets(totals.select("source", "source_size"), weights, share, cap)
    seats = aims.withColumn("all", F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)).withColumn("g", F.lit(0))
    aims = written(apportion(seats, ["g"], ["source"], "target", "all").select(F.col("source").alias("s"), "source_size", "target", F.col("quota").alias("source_quota")), "aims")
    shard_counts = totals.select(F.col("source").alias("s"), "shards")
    sharded = lambda rows: rows.join(shard_counts, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("shard", _number("h") % F.col("shards"))
    shards = sharded(sized).groupBy("source", "shard").agg(F.sum("size").alias("shard_words")).join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shards = apportion(shards, ["source"], ["shard"], "shard_words", "source_quota")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("shard_words") / block)).cast("long")
    shards = shards.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.col("blocks") * cap))
    shards = shards.withColumn("whole", F.floor(F.col("quota") / F.col("blocks"))).withColumn("rest", F.col("quota") % F.col("blocks"))
    spin = _number(F.md5(F.concat_ws("/", F.lit(f"{seed} spin"), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))))
    shards = written(shards.withColumn("offset", spin % F.col("blocks")).withColumnsRenamed({"source": "s", "shard": "d"}).drop("source_quota", "quota"), "shards")
    placed = sharded(of_docs if whole_rows else sized).withColumn("last", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("h", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("first", F.col("last") - F.col("size"))
    joined = placed.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("d")))
    extra = extra_before(F.col("last"), block) - extra_before(F.col("first"), block)
    return joined.select(
        F.col("__id").alias(id_col), "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"),
        "first", "shard_words", "blocks", "whole", "rest", "offset", *["doc"] * whole_rows,
    )


def chosen_before(b: Column) -> Column:
    """How many of a shard's blocks 0 .. b-1 the systematic choice takes."""
    return F.floor((b * F.col("rest") + F.col("offset")) / F.col("blocks"))


def extra_before(x: Column, block: int) -> Column:
    """How many of a shard's words 0 .. x-1 stand in chosen blocks."""
    b = F.floor(x / block)
    return chosen_before(b) * block + (x - b * block) * (chosen_before(b + 1) - chosen_before(b))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy taken of a document, and a row with
    the words (and the white space after each) of its blocks that are taken once more, if there are any.

    Where docs has n_chars, it holds the code points of the new text. See mix() for the parameters.
    """
    taken = mix(docs, id_col, text_col, source_col, block=block, whole_rows=True, **how).drop(id_col)
    text = F.col("doc")[text_col]
    words = F.regexp_extract_all(text, F.lit(rf"^[\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*|{WORD}[\x20\x09-\x0D]*"), F.lit(0))

    def chosen(_, i):
        b = F.floor((F.col("first") + i) / block)
        return chosen_before(b + 1) > chosen_before(b)

    some = F.when(F.col("taken") > F.col("whole") * F.col("size"), F.array(F.array_join(F.filter(words, chosen), "")))
    texts = F.concat(F.array_repeat(text, F.col("whole").cast("int")), F.coalesce(some, F.array().cast("array<string>")))
    copies = taken.where("taken > 0").select("doc", F.explode(texts).alias("piece"))
    new = {text_col: F.col("piece")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("piece").cast(docs.schema["n_chars"].dataType)
    return copies.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
