"""Secret scans by fixed patterns and by a battery of randomness tests, in DataFrame operations only.

Patterns find assigned passwords and tokens, access keys and long hexadecimal strings. Beyond them, every run
of 20 or more characters of the usual encodings that holds a letter is a candidate. Its encoding is inferred
(hexadecimal, letters alone, base 32, letters of one case with digits, letters with digits, base 64, plain or for URLs, or a mixture), and
three tests compare it with evenly random text of that alphabet and length: chi-squared uniformity, the runs
test about the middle of the alphabet, and the correlation of neighbouring characters. A candidate that any
of them rejects at `alpha` is not random.

Short strings can look random by chance, so the rest must also differ from natural text: under skewed letter
frequencies (`skew` times the even sum of squares) chi-squared would be larger by an amount that grows with
the length. The p-value of that is small only for strings long enough to tell, and Benjamini-Hochberg
control at `rate` within each encoding and length class bounds the share of natural strings among the reports.
p-values are counted in a fixed number of bins, so no list of candidates is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescribe.llm.common import written

#: kind -> (pattern, the group whose length counts, its least length, the group that is the find), in the order in
#: which kinds are listed.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, 0),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16, 0),  # a run that is too short holds no longer one
    "hex": (r"[0-9a-f]{32,}", 0, 32, 0),
    # a run starts only after what can't be in one; '=' is padding only where no run follows it, as after a long name
    "random": (r"(?<![\w+/-])[\w+/-]{20,}+={0,2}(?![\w+/-])", 0, 20, 0),
}
KINDS = tuple(PATTERNS)
#: How often two characters of natural text are the same.
COLLISION = 0.055
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding -> (pattern, alphabet), the first that fits.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "small": (r"^[a-z]+$", _LOWER),
    "capital": (r"^[A-Z]+$", _UPPER),
    "letters": (r"^[A-Za-z]+$", _UPPER + _LOWER),
    "base32": (r"^[A-Z2-7]+$", _UPPER + "234567"),
    "lower": (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    "upper": (r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    "alnum": (r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    "base64": (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    "mixed": (r"^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/-_"),
}


def _may_match(text: Column) -> dict[str, Column]:
    """Cheap conditions without which a text has no match of a kind."""
    low = F.lower(text)
    word = F.contains(low, F.lit("passw"))
    for w in ("secret", "token", "apikey", "api_key"):
        word = word | F.contains(low, F.lit(w))
    run = text.rlike(PATTERNS["random"][0])  # a long hexadecimal string is in such a run
    return {"assign": word, "access": F.contains(text, F.lit("AKIA")), "hex": run, "random": run}


def _matches(text: Column, kind: str) -> Column:
    """Matches of a kind in a text: the find, the length that counts, the length of the text from the find before to
    the end of this one."""
    pattern, group, _, find = PATTERNS[kind]
    extracted = {g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in {0, group, find}}
    whole = extracted[0]
    gaps = F.slice(F.transform(F.split(text, pattern), F.length), 1, F.size(whole))
    step = F.zip_with(gaps, F.transform(whole, F.length), lambda a, b: a + b)
    some = F.arrays_zip(extracted[find].alias("m"), F.transform(extracted[group], F.length).alias("size"), step.alias("step"))
    return F.when(F.size(whole) > 0, some)


def _normal(z: Column) -> Column:
    """Probability below z of the standard normal distribution, to about 0.0002."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z))))


def battery(tokens: DataFrame, skew: float = 1.7) -> DataFrame:
    """tokens (token, ...) with columns encoding, n, chi2, p_uniform, p_runs, p_serial, p_natural.

    Tokens without a letter or of no known encoding are left out.
    """
    core = F.regexp_replace("token", "=+$", "")
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (pattern, letters) in reversed(ENCODINGS.items()):
        encoding = F.when(F.col("core").rlike(pattern), name).otherwise(encoding)
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    t = tokens.withColumn("core", core).where(F.col("core").rlike("[A-Za-z]"))
    t = t.withColumn("encoding", encoding).where("encoding is not null").withColumn("alphabet", alphabet)
    t = t.withColumn("n", F.length("core").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    t = written(t, "candidates")  # between steps, lest the optimizer write out each where it is used
    zero = F.lit(0.0)
    count = lambda c: F.col("n") - F.length(F.replace(F.col("core"), c, F.lit("")))
    squares = F.aggregate(F.split("alphabet", ""), zero, lambda s, c: s + count(c) * count(c))
    index = F.transform(F.split("core", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1)
    t = t.withColumn("chi2", F.col("k") / F.col("n") * squares - F.col("n")).withColumn("x", index)
    t = written(t, "indexes").withColumn("mean", F.aggregate("x", zero, lambda s, v: s + v) / F.col("n"))
    t = t.withColumn("high", F.aggregate("x", zero, lambda s, v: s + F.when(v >= F.col("k") / 2, 1.0).otherwise(0.0)))
    t = written(t, "moments")
    first, second = F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1)
    changes = F.aggregate(F.zip_with(first, second, lambda a, b: F.when((a >= F.col("k") / 2) != (b >= F.col("k") / 2), 1.0).otherwise(0.0)), zero, lambda s, v: s + v)
    products = F.aggregate(F.zip_with(first, second, lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), zero, lambda s, v: s + v)
    spread = F.aggregate("x", zero, lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    t = written(t.withColumn("changes", changes).withColumn("products", products).withColumn("spread", spread), "sums")
    n, k, df = F.col("n"), F.col("k"), F.col("k") - 1
    cube = lambda v: F.pow(F.greatest(v, F.lit(0.0)), 1 / 3)
    hilferty = lambda chi, d: (cube(chi / d) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    mu = 2 * F.col("high") * (n - F.col("high")) / n + 1
    runs = F.when(mu > 2, (F.col("changes") + 1 - mu) / F.sqrt((mu - 1) * (mu - 2) / (n - 1))).otherwise(F.lit(99.0))
    serial = F.when(F.col("spread") > 0, F.col("products") / F.col("spread") * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.lit(99.0))
    # under skewed frequencies chi-squared grows by (n - 1)(skew - 1): moments of a non-central chi-squared. Natural
    # text uses few of a large alphabet's characters, so that two of them agree in COLLISION of all cases at least
    excess = (n - 1) * (F.greatest(F.lit(skew), COLLISION * k) - 1)
    natural = (F.col("chi2") - df - excess) / F.sqrt(2 * (df + 2 * excess))
    t = t.withColumn("z_uniform", hilferty(F.col("chi2"), df)).withColumn("z_runs", F.abs(runs)).withColumn("z_serial", F.abs(serial)).withColumn("z_natural", natural)
    t = written(t.drop("x"), "tests")
    return written(t.select(
        *tokens.columns, "encoding", "n", "chi2", (1 - _normal(F.col("z_uniform"))).alias("p_uniform"),
        (2 * (1 - _normal(F.col("z_runs")))).alias("p_runs"), (2 * (1 - _normal(F.col("z_serial")))).alias("p_serial"), _normal(F.col("z_natural")).alias("p_natural"),
    ), "tested")


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """The rows of tested (encoding, n, p_natural) that Benjamini-Hochberg keeps at `rate` within encoding and length class.

    p-values are rounded up to 10 ** (-bin / 200), bin 0 .. 3000, which makes the control a little stricter.
    """
    binned = tested.withColumn("class", F.floor(F.log2("n") * 2)).withColumn("bin", F.least(F.lit(3000), F.floor(-200 * F.log10(F.greatest("p_natural", F.lit(1e-15))))))
    counts = binned.groupBy("encoding", "class", "bin").agg(F.count("*").alias("c"))
    stratum = Window.partitionBy("encoding", "class")
    up_to = stratum.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("below", F.sum("c").over(up_to)).withColumn("all", F.sum("c").over(stratum))
    limits = counts.where(F.pow(F.lit(10.0), -F.col("bin") / 200) <= rate * F.col("below") / F.col("all")).groupBy("encoding", "class").agg(F.min("bin").alias("limit"))
    return binned.join(limits, ["encoding", "class"]).where(F.col("bin") >= F.col("limit")).drop("class", "bin", "limit")


def _found(docs: DataFrame, id_col: str, text_col: str, whole_rows: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"), *[c.alias(f"may_{k}") for k, c in _may_match(text).items()], *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] * whole_rows)
    return written(rows.select("row", "id", *[F.when(F.col(f"may_{k}"), _matches(F.col("text"), k)).alias(k) for k in KINDS], *["doc"] * whole_rows), "matches")


def spans(found: DataFrame, alpha: float = 0.001, rate: float = 0.05, skew: float = 1.7) -> DataFrame:
    """(row, kind, start, end): the pattern matches that are long enough, and random strings that touch none of them."""
    parts = [found.where(F.col(k).isNotNull()).select("row", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "x")) for k in KINDS]
    each = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    to_here = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("x.step").over(to_here)
    least = F.lit(0)
    for k, (_, _, size, _) in PATTERNS.items():
        least = F.when(F.col("kind") == k, size).otherwise(least)
    each = each.select("row", "kind", (end - F.length("x.m")).alias("start"), end.alias("end"), F.col("x.m").alias("token"), F.col("x.size").alias("size"))
    each = written(each.where(F.col("size") >= least), "spans")
    base = each.where("kind <> 'random'").select("row", "kind", "start", "end")
    tested = battery(each.where("kind = 'random'").drop("size"), skew).where(F.least("p_uniform", "p_runs", "p_serial") * 3 >= alpha)
    more = discoveries(tested, rate).select("row", "kind", "start", "end")
    by_start = Window.partitionBy("row").orderBy("start", "end")
    fixed = F.col("kind") != "random"
    both = base.unionAll(more).withColumn("before", F.max(F.when(fixed, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.min(F.when(fixed, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing)))
    touches = (F.coalesce("before", F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("after") < F.col("end"), F.lit(False)))
    return both.where(fixed | ~touches).select("row", "kind", "start", "end")


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span of these kinds, by start, then kind as listed, comma-joined."""
    rank = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        rank = F.when(F.col("kind") == k, i).otherwise(rank)
    item = F.struct(F.col("start").alias("s"), rank.alias("k"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("t"))
    chosen = F.collect_list(F.when(F.col("kind").isin(*kinds), item))
    return F.array_join(F.transform(F.array_sort(chosen), lambda x: x["t"]), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind as listed, comma-joined; base_sha256
    is the hash of that list of the pattern matches alone. Null texts are empty, texts without finds have empty
    lists. Each row is scanned by itself, also if it repeats another's id or text. Other columns are ignored. An
    empty table gives an empty result.
    """
    found = _found(docs, id_col, text_col, False)
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    per_row = spans(found, **how).groupBy("row").agg(*[of(k) for k in KINDS], _listed(KINDS[:3]).alias("base"), _listed(KINDS).alias("spans"))
    out = found.select("row", "id").join(per_row, "row", "left")
    return out.select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", **how) -> DataFrame:
    """docs with every secret in its texts replaced by mark; touching and overlapping finds become one mark.

    All rows and columns stay; where docs has n_chars, it holds the code points of the new text.
    """
    found = _found(docs, text_col, text_col, True).drop("id")
    by_start = Window.partitionBy("row").orderBy("start", "end")
    s = spans(found.drop("doc"), **how).withColumn("reach", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    s = s.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    cuts = s.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "start", "end"))).alias("cuts"))
    text = F.col(f"doc.{text_col}")
    pieces = F.transform("cuts", lambda c: F.concat(F.substring(text, c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), F.lit(mark)))
    last = F.substring(text, F.element_at("cuts", -1)["end"].cast("int") + 1, F.length(text))
    touched = found.where(F.greatest(*[F.col(k).isNotNull() for k in KINDS]))
    changed = touched.select("row", "doc").join(cuts, "row", "left").select("doc", F.when(F.col("cuts").isNotNull(), F.concat(F.array_join(pieces, ""), last)).otherwise(text).alias("new"))
    same = found.where(~F.greatest(*[F.col(k).isNotNull() for k in KINDS])).select("doc", text.alias("new"))
    new = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        length = F.length("new").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("new").eqNullSafe(text), F.col("doc.n_chars")).otherwise(length)
    return same.unionAll(changed).select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
