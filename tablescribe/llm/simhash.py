"""SimHash near-duplicates found by pigeonring filtering.

A document's fingerprint has a bit set where over half the XXH64 hashes of its word shingles have it.
Two fingerprints link if at most `max_diff` bits differ. The 64 bits are cut into max_diff + 1
consecutive segments in a ring. If the whole differs in at most max_diff bits, then from some segment
on, every chain of l consecutive segments differs in at most l * max_diff / (max_diff + 1) bits: the
first segment in none, the first two in one at most. A join on the key (first segment, second segment
with at most one bit flipped) brings together the pairs with such a chain and no others; the full
Hamming distance is checked in the join. Work and rows per fingerprint don't grow with the input.

keep_one, for near copies at a similarity of shingle sets, takes longer fingerprints: their segments stand on
the same ring, a chain of two without a difference makes a candidate (budgets in proportion, below half a bit a segment), the
full Hamming distance prunes, and the texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.llm.common import components, small_batches, written


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text as a signed number; 0 for null or a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z are lowered, ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) > shingle:
        ends = ends[shingle - 1 :]
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[i : j - 1], 42) for i, j in zip(starts, ends)), np.uint64, len(ends))
    else:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: str | Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return of(text)


def _segments(max_diff: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    n = max_diff + 1
    at = [64 * i // n for i in range(n + 1)]
    return [(at[i], at[i + 1] - at[i]) for i in range(n)]


def _part(x: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else x


def _flipped(i: int, key: Column):
    return lambda flip: F.struct(F.lit(i).alias("i"), key.bitwiseXOR(flip).alias("key"))


def links(prints: DataFrame, max_diff: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of column fp that differ in 1 to max_diff bits, each once."""
    if max_diff < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    segments = _segments(max_diff)
    n = len(segments)
    fp = F.col("fp")
    keys, probes = [], []
    for i, (at, width) in enumerate(segments):
        near, near_width = segments[(i + 1) % n]
        # at most 64 bits for two segments; the number of the segment goes beside them
        key = F.shiftleft(_part(fp, near, near_width), width).bitwiseOR(_part(fp, at, width))
        keys.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << (width + b) if width + b < 63 else -(1 << 63)).cast("long") for b in range(near_width)])
        probes.append(F.transform(flips, _flipped(i, key)))
    kept = prints.select(F.col("fp").alias("b"), F.inline(F.array(*keys)))
    asked = prints.select(F.col("fp").alias("a"), F.inline(F.flatten(F.array(*probes))))
    x = F.col("a").bitwiseXOR(F.col("b"))
    viable = [(_part(x, *segments[i]) == 0) & (F.bit_count(_part(x, *segments[(i + 1) % n])) <= 1) for i in range(n)]
    first = F.lit(True)
    for i in range(n):  # a pair may have several viable chains; the first one reports it
        earlier = F.lit(False)
        for v in viable[:i]:
            earlier = earlier | v
        first = first & ((F.col("i") != i) | ~earlier)
    pairs = asked.join(kept.hint("shuffle_hash"), ["i", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_diff) & first)
    return pairs.select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_diff: int = 2) -> DataFrame:
    """One row per input row: the id, fp (signed fingerprint), fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links, the row's own included. Texts without words
    (null, empty, white space) share fingerprint zero and so one component. Repeated rows each get
    their row. A null id keeps its row and is the component's id only if the component has no other.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp")), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct, max_diff))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a similarity of shingle sets: longer fingerprints, the same ring of segments.

#: Bits of a segment, and how many segments in a row a chain has.
_SEGMENT, _CHAIN = 12, 2
#: Longs of a fingerprint that a member of a bucket carries with it.
_HEAD = 8
#: Leaders that a node is held against in a round, the nearest ones.
_LEADERS = 3
#: Buckets of the filters that go to every task: at most so many numbers, whatever the input.
_BUCKETS = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of the word shingles (fewer words: of all words; none: no hash)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[i : j - 1], 42) for i, j in zip(starts, ends)), np.uint64, len(ends)))


def long_fingerprint(text: str | None, shingle: int, longs: int) -> np.ndarray:
    """A SimHash of 64 * longs bits of the set of shingles, as signed numbers: each hash is spread over all bits."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(64 * longs, np.int64)
    step = (np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for i in range(0, len(hashes), 255):  # so many fit into a byte
        x = hashes[i : i + 255, None] + step
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
        ones += np.add.reduce(np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def chain_keys(fp: np.ndarray) -> np.ndarray:
    """Keys of fingerprints (a row each): for each chain where it starts on the ring, and the bits of its segments."""
    bits = np.unpackbits(fp.astype("<i8").view(np.uint8), axis=1, bitorder="little")
    n = bits.shape[1] // _SEGMENT
    segments = bits[:, : n * _SEGMENT].reshape(len(fp), n, _SEGMENT) @ (1 << np.arange(_SEGMENT, dtype=np.int64))
    keys = np.broadcast_to(np.arange(n, dtype=np.int64), segments.shape)
    for k in range(_CHAIN):
        keys = (keys << _SEGMENT) | np.roll(segments, -k, axis=1)
    return keys


def bits_apart(similarity: float, longs: int, deviations: float = 3) -> int:
    """Bits that fingerprints of sets of equal size with this Jaccard similarity differ in at most: the mean and three deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(64 * longs * share + deviations * np.sqrt(64 * longs * share * (1 - share))))


def _in_buckets(df: DataFrame, key: str, rows: DataFrame, how: str) -> DataFrame:
    """The rows of df whose key falls ("left_semi") or doesn't ("left_anti") into a hash bucket with a `row` of
    rows: at most _BUCKETS numbers are broadcast, so most of a large table needn't be shuffled for a join."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(_BUCKETS))
    return df.join(F.broadcast(rows.select(at("row").alias("__bucket")).distinct()), at(key) == F.col("__bucket"), how)


def similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame, shingle: int, similarity: float, longs: int) -> DataFrame:
    """Of the distinct pairs (a, b) of nodes those whose fingerprints are near enough, and whose texts then reach the
    Jaccard similarity. prints: (node, fp, row), texts: (row, text)."""
    near = pairs.join(prints.select(F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("row").alias("ra")), "a")
    near = near.join(prints.select(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("row").alias("rb")), "b")
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    near = written(near.where(apart <= bits_apart(similarity, longs)).select("a", "b", "ra", "rb"), "near")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = shingle_hashes(x, shingle), shingle_hashes(y, shingle)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    rows = near.select(F.explode(F.array("ra", "rb")).alias("row")).distinct()
    asked = written(_in_buckets(texts, "row", rows, "left_semi").join(rows, "row", "left_semi").dropDuplicates(["row"]), "texts")
    of = lambda k: asked.select(F.col("row").alias(f"r{k}"), F.col("text").alias(f"t{k}"))
    return written(near.join(of("a"), "ra").join(of("b"), "rb").where(alike("ta", "tb")).select("a", "b"), "similar")


def shared_keys(keys: DataFrame, similarity: float) -> DataFrame:
    """The rows of keys (node, h0, key) whose key several nodes have. Of two nodes alone, which are mostly together by chance, the
    first longs h0 must be near as well: their xor is that of the bucket, so no pair is laid out for it."""
    bucket = Window.partitionBy("key")
    held = keys.withColumn("__n", F.count("*").over(bucket)).withColumn("__x", F.bit_xor("h0").over(bucket))
    return held.where((F.col("__n") > 2) | ((F.col("__n") == 2) & (F.bit_count("__x") <= bits_apart(similarity, 1, 4.5)))).drop("__n", "__x")


def nearest_leaders(members: DataFrame, round_: int, rounds: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes: each bucket of the round's chains names a leader by chance, and each node a takes the nearest few of the
    leaders b of other groups in its buckets, by the first bits of the fingerprints."""
    now = members.where(F.shiftright("key", _SEGMENT * _CHAIN) % rounds == round_)
    leader = F.struct(F.col("group").alias("leader_group"), F.col("node").alias("leader"), *_other_head())
    leaders = now.groupBy("key").agg(F.min_by(leader, F.struct(F.xxhash64("node", "key"), F.col("node"))).alias("l")).select("key", "l.*")
    met = now.join(leaders, "key").where((F.col("group") != F.col("leader_group")) & (_head_apart() <= bits_apart(similarity, _HEAD)))
    seen = met.groupBy(F.col("node").alias("a")).agg(F.array_sort(F.collect_set(F.struct(_head_apart().alias("apart"), "leader"))).alias("l"))  # a node has as many buckets as chains
    return seen.select("a", F.explode(F.slice("l", 1, _LEADERS)["leader"]).alias("b"))


def _other_head() -> list[Column]:
    return [F.col(f"h{i}").alias(f"o{i}") for i in range(_HEAD)]


def _head_apart() -> Column:
    return sum((F.bit_count(F.col(f"h{i}").bitwiseXOR(F.col(f"o{i}"))) for i in range(1, _HEAD)), F.bit_count(F.col("h0").bitwiseXOR(F.col("o0"))))


def clusters(docs: DataFrame, row_col: str, text_col: str, shingle: int, similarity: float, longs: int, rounds: int = 2) -> DataFrame:
    """(row, least): for each row of docs the least row of its group. Rows link where the Jaccard similarity of
    their sets of word shingles reaches `similarity`.

    Candidates share a chain of segments of their fingerprints without a difference. Rows with equal fingerprints are one node.
    In each round a share of the chains is looked at: their buckets have a leader each, and nodes are compared with the nearest leaders
    of other groups, so that many near copies become few groups. Then all pairs of all buckets that are still in different
    groups are compared. No pair within a group is laid out.
    """

    @F.pandas_udf("array<long>")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([long_fingerprint(t, shingle, longs) for t in texts])

    @F.pandas_udf("array<long>")
    def chains(prints: pd.Series) -> pd.Series:
        return pd.Series([k for i in range(0, len(prints), 1000) for k in chain_keys(np.stack(prints.iloc[i : i + 1000]))], dtype=object)

    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    prints = written(texts.select("row", fingerprints("text").alias("fp")), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("row").alias("row")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each node becomes many keys: small tasks
    keys = nodes.select("node", "fp").repartition(parts).select("node", F.element_at("fp", 1).alias("h0"), F.explode(chains("fp")).alias("key"))
    keys = keys.repartition(4 * parts, "key")
    head = nodes.select("node", *[F.element_at("fp", i + 1).alias(f"h{i}") for i in range(1, _HEAD)])
    members = written(shared_keys(keys, similarity).join(head, "node").withColumn("group", F.col("node")), "members")
    links = None
    for k in range(rounds + 1):
        if k < rounds:
            pairs = nearest_leaders(members, k, rounds, similarity)
        else:
            others = members.select("key", F.col("node").alias("b"), F.col("group").alias("other"), *_other_head())
            apart = (F.col("node") < F.col("b")) & (F.col("group") != F.col("other")) & (_head_apart() <= bits_apart(similarity, _HEAD))
            pairs = members.join(others, "key").where(apart).select(F.col("node").alias("a"), "b").distinct()
        found = similar(pairs, nodes, texts, shingle, similarity, longs)
        links = written(found if links is None else links.unionAll(found), "links")
        roots = components(links).withColumnRenamed("root", "new")
        if k < rounds:  # buckets whose nodes are one group by now have nothing left to compare
            grouped = members.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").withColumn("group", F.coalesce("new", "node")).drop("__n", "new")
            bucket = Window.partitionBy("key")
            members = written(grouped.withColumn("__open", F.min("group").over(bucket) < F.max("group").over(bucket)).where("__open").drop("__open"), "members")
    placed = nodes.join(roots, "node", "left").select("fp", "row", F.coalesce("new", "node").alias("group"))
    least = placed.groupBy("group").agg(F.min("row").alias("least"))
    return prints.join(placed.join(least, "group").select("fp", "least"), "fp").select("row", "least")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, longs: int = 44) -> DataFrame:
    """docs without near-duplicates: of each group of linked rows the one with the smallest id stays, once.

    Rows link where the sets of their five-word shingles have a Jaccard similarity of 0.8 or more (fewer words:
    all words as one shingle). Fingerprints of 2,816 bits find 98 % of the pairs at 0.8 exactly, nearly all from
    0.85 on; every link is checked on the texts, so no others are joined. Beyond some ten million distinct texts, chains
    of three segments and more bits keep the buckets small.

    Texts without words (null, empty, white space) are one group. A null id counts as the smallest. Rows that share id
    and text stay as one row. All columns are kept, whatever their names. An empty table gives an empty result.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    named = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    with small_batches(docs.sparkSession):
        groups = written(clusters(named, row, text_col, shingle, similarity, longs), "groups")
    gone = groups.groupBy("row").agg(F.first("least").alias("least"), F.count("*").alias("n")).where("n > 1 or row != least")
    gone = written(gone.select("row", (F.col("row") == F.col("least")).alias("stays")), "gone")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    asked = _in_buckets(named, row, gone, "left_semi").join(gone.withColumnRenamed("row", "__gone"), F.col(row) == F.col("__gone"), "left").where("stays is null or stays")
    once = asked.where("stays").groupBy(row).agg(F.first(rest).alias("__kept")).select("__kept.*")
    return _in_buckets(named, row, gone, "left_anti").drop(row).unionAll(asked.where("stays is null").select(*[F.col(f"`{c}`") for c in docs.columns])).unionAll(once)
