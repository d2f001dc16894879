"""Queries over the driver's tables, one for each operator, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.functions.numbers import CODE, CURRENCY, DATE, DECIMAL, INT, MONEY, MONEY_LOOSE, PERCENT, close, half_up, parse_number, token_class
from tablescribe.operators import aggregates, boxes, joins, windows
from tablescribe.plans.registry import pattern_sql as _sql
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

CLOSE_SQL = "abs(({a}) - ({b})) <= greatest(0.011, 0.02 * greatest(abs({a}), abs({b})))"

@query(f"""
WITH s AS (SELECT l_orderkey k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) s FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, floor((s + 2.220446049250313e-16) * 100 + 0.5) / 100 AS line_sum, o_totalprice AS total,
  CASE WHEN s IS NULL THEN 'no_lines' WHEN {CLOSE_SQL.format(a="s", b="o_totalprice")} THEN 'ok' ELSE 'mismatch' END AS status
FROM orders LEFT JOIN s ON k = o_orderkey""")
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return aggregates.reconcile(table(spark, sf_dir, "lineitem"), "l_orderkey", revenue, table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


LINES = """l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS qty,
 CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 2 THEN p_retailprice / 100 WHEN l_linenumber = 3 THEN p_retailprice ELSE l_extendedprice / l_quantity END AS price,
 CASE WHEN l_linenumber = 4 OR l_linenumber = 7 AND l_partkey > 1000 THEN NULL WHEN l_linenumber = 1 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS amount,
 CASE WHEN l_linenumber = 1 THEN l_extendedprice * l_discount END AS discount"""


@query(f"""
WITH l AS (SELECT {LINES} FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT *, qty * price AS e FROM l)
SELECT l_orderkey, l_linenumber,
  floor(1000 * CASE WHEN qty IS NULL AND price <> 0 THEN floor((amount / price + 2.220446049250313e-16) * 100 + 0.5) / 100 ELSE qty END + 0.5) / 1000 AS qty,
  floor(1000 * CASE WHEN price IS NULL AND qty <> 0 THEN floor((amount / qty + 2.220446049250313e-16) * 100 + 0.5) / 100 ELSE price END + 0.5) / 1000 AS price,
  floor(1000 * CASE WHEN amount IS NULL THEN floor((e + 2.220446049250313e-16) * 100 + 0.5) / 100 ELSE amount END + 0.5) / 1000 AS amount,
  CASE WHEN qty IS NULL AND price <> 0 AND amount IS NOT NULL OR price IS NULL AND qty <> 0 AND amount IS NOT NULL OR amount IS NULL AND qty IS NOT NULL AND price IS NOT NULL THEN 'derived'
       WHEN qty IS NULL OR price IS NULL OR amount IS NULL THEN 'unavailable'
       WHEN {CLOSE_SQL.format(a="e", b="amount")} THEN 'ok' WHEN discount IS NOT NULL AND {CLOSE_SQL.format(a="(e - discount)", b="amount")} THEN 'ok'
       WHEN {CLOSE_SQL.format(a="(e / 100)", b="amount")} OR {CLOSE_SQL.format(a="(e * 100)", b="amount")} THEN 'decimal-point' ELSE 'mismatch' END AS status
FROM d""")
def line_check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(*_columns(LINES))
    checked = aggregates.check_lines(lines, "qty", "price", "amount", "discount")
    return checked.select("l_orderkey", "l_linenumber", *[half_up(F.col(c), 3).alias(c) for c in ("qty", "price", "amount")], "status")


def _columns(listed: str) -> list[str]:
    """The columns of a select list of plain expressions, split at the commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[start:i])
            start = i + 1
    return [*out, listed[start:]]


@query("""
SELECT n_name, l_returnflag, grouping(n_name, l_returnflag)::BIGINT AS level, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS amount
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
GROUP BY GROUPING SETS ((n_name, l_returnflag), (n_name), ())""")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    lines = lines.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    sets = lines.groupingSets([["n_name", "l_returnflag"], ["n_name"], []], "n_name", "l_returnflag")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("""
WITH e AS (SELECT *, event_type = 'signup' AND EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND (f.ts, f.event_id) > (e.ts, e.event_id)) AS opens FROM events e)
SELECT event_id, user_id, event_type, last_value(CASE WHEN opens THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_group
FROM e""")
def group_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    carried = windows.open_groups(events, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "purchase", F.col("event_id"), "open_group")
    return carried.select("event_id", "user_id", "event_type", "open_group")


@query("""
WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT *, n < 0.98 * avg(n) OVER (PARTITION BY event_type) AS low FROM d),
r AS (SELECT *, sum(CASE WHEN low AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY day) AS run
      FROM (SELECT *, lag(low) OVER (PARTITION BY event_type ORDER BY day) AS p FROM m))
SELECT event_type, min(day) AS first, max(day) AS last, count(*) AS "rows" FROM r WHERE low GROUP BY event_type, run HAVING count(*) >= 2""")
def islands_low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    marked = days.join(days.groupBy("event_type").agg(F.avg("n").alias("mean")), "event_type")
    return windows.islands(marked, ["event_type"], ["day"], F.col("n") < 0.98 * F.col("mean"), 2)


@query("""
WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM d""")
def moving_average_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return windows.moving_average(days, ["event_type"], "day", "n", 2).withColumn("smooth", F.round("smooth", 6))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM lineitem)
SELECT l_orderkey, round(avg(CASE WHEN d IS NULL THEN NULL WHEN d = 1 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS "rows" FROM s GROUP BY 1""")
def sequential_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sequential_share(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber").withColumn("share", F.round("share", 6))


@query("""
WITH s AS (SELECT l_suppkey, l_extendedprice v, sum(l_quantity) w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) c, sum(w) OVER (PARTITION BY l_suppkey) t FROM s)
SELECT l_suppkey, min(v) AS weighted_median FROM c WHERE c >= t / 2 GROUP BY 1""")
def weighted_median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weighted_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("SELECT p_brand, list_sort(list(p_retailprice))[(count(*) // 2) + 1] AS upper_median FROM part GROUP BY 1")
def upper_median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.upper_median(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


@query("""
WITH m AS (SELECT l_partkey, median(l_quantity) m FROM lineitem GROUP BY 1)
SELECT l_partkey, median(abs(l_quantity - m)) AS mad FROM lineitem JOIN m USING (l_partkey) GROUP BY 1""")
def median_deviation_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.median_deviation(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")


@query("""
WITH c AS (SELECT p_brand, p_size, count(*) n FROM part GROUP BY 1, 2)
SELECT p_brand, p_size AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size DESC) = 1""")
def mode_larger_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mode_larger(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


TOKENS_SQL = """(
SELECT 'brand' AS col, p_brand AS token FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'percent', CAST(p_size AS VARCHAR) || ' %' FROM part
UNION ALL SELECT 'money', '$' || CAST(p_size AS VARCHAR) || '.50' FROM part UNION ALL SELECT 'grouped', CAST(p_size AS VARCHAR) || ',234.56' FROM part UNION ALL SELECT 'code', 'PX-' || CAST(p_partkey AS VARCHAR) FROM part
UNION ALL SELECT 'date', '12/03/20' || CAST(10 + p_size % 80 AS VARCHAR) FROM part UNION ALL SELECT 'negative', '(' || CAST(p_size AS VARCHAR) || ',5)' FROM part UNION ALL SELECT 'empty', ' ' FROM part UNION ALL SELECT 'tab', chr(9) || ' ' FROM part UNION ALL SELECT 'marked', CAST(p_size AS VARCHAR) || '#50' FROM part
UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'units', CAST(p_size AS VARCHAR) || ' pcs' FROM part)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    kinds = {
        "brand": F.col("p_brand"), "size": size, "percent": F.concat(size, F.lit(" %")), "money": F.concat(F.lit("$"), size, F.lit(".50")), "grouped": F.concat(size, F.lit(",234.56")),
        "code": F.concat(F.lit("PX-"), F.col("p_partkey").cast("string")), "date": F.concat(F.lit("12/03/20"), (10 + F.col("p_size") % 80).cast("string")),
        "negative": F.concat(F.lit("("), size, F.lit(",5)")), "empty": F.lit(" "), "tab": F.lit("\t "), "marked": F.concat(size, F.lit("#50")), "type": F.col("p_type"), "units": F.concat(size, F.lit(" pcs")),
    }
    return table(spark, sf_dir, "part").select(F.explode(F.array(*[F.struct(F.lit(k).alias("col"), v.alias("token")) for k, v in kinds.items()])).alias("t")).select("t.*")


CLASS_SQL = f"""CASE WHEN trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = '' THEN 'empty' WHEN regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(PERCENT)}) THEN 'percent'
 WHEN regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(MONEY)}) OR regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(MONEY_LOOSE)}) THEN 'money' WHEN regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(DATE)}) THEN 'date'
 WHEN regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(INT)}) THEN 'int' WHEN regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(DECIMAL)}) THEN 'decimal'
 WHEN regexp_matches(trim(token, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), {_sql(CODE)}) AND regexp_matches(token, '[0-9]') THEN 'code' ELSE 'text' END"""


@query(f"""
WITH c AS (SELECT col, {CLASS_SQL} AS kind, count(*) n FROM {TOKENS_SQL} GROUP BY 1, 2)
SELECT col, kind, n, round(n / sum(n) OVER (PARTITION BY col), 6) AS share FROM c""")
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _tokens(spark, sf_dir).groupBy("col", token_class(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("col").agg(F.sum("n").alias("all"))
    return counts.join(totals, "col").select("col", "kind", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(f"""
WITH b AS (SELECT col, token, trim(regexp_replace(token, '(?i){CURRENCY}', '', 'g'), ' ' || chr(9)) AS s FROM {TOKENS_SQL}),
d AS (SELECT *, regexp_replace(s, '[()\\-\\s]', '', 'g') AS d FROM b),
p AS (SELECT *, CASE WHEN regexp_matches(d, '[.,]\\d{{1,2}}$') THEN regexp_replace(regexp_extract(d, '^(.*)[.,]\\d{{1,2}}$', 1), '[.,]', '', 'g') || '.' || regexp_extract(d, '[.,](\\d{{1,2}})$', 1) ELSE regexp_replace(d, '[.,]', '', 'g') END AS p FROM d)
SELECT col, count(*) AS n, count(v) AS parsed, round(sum(v), 4) AS total FROM (
  SELECT col, CASE WHEN regexp_matches(s, '^\\(.*\\)$') OR s LIKE '-%' THEN -1 ELSE 1 END * CASE WHEN regexp_matches(p, '^\\d+(\\.\\d+)?$|^\\.\\d+$') THEN try_cast(p AS DOUBLE) END AS v FROM p)
GROUP BY col""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _tokens(spark, sf_dir).withColumn("v", parse_number(F.col("token")))
    return parsed.groupBy("col").agg(F.count("*").alias("n"), F.count("v").alias("parsed"), F.round(F.sum("v"), 4).alias("total"))


@query("""
SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_id, value, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY value DESC, event_id) AS rank
FROM events QUALIFY rank <= 3""")
def topk_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string"))
    return windows.top_per_group(events, ["event_type", "hour"], [F.desc("value"), F.asc("event_id")], 3).select("event_type", "hour", "event_id", "value", "rank")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(lower(trim(text)))")
def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("h"))
    return windows.keep_first(docs, [F.col("h")], ["doc_id"]).select("doc_id", "copies")


SPAN = """(SELECT event_id, user_id, event_type, epoch(ts) AS lo, epoch(ts) + 7200 AS hi FROM events WHERE event_type {})"""


@query(f"""
WITH a AS {SPAN.format("= 'purchase'")}, b AS {SPAN.format("= 'click'")}
SELECT event_id, user_id, event_type FROM b UNION ALL
SELECT event_id, user_id, event_type FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND a.lo < b.hi AND b.lo < a.hi)""")
def overlap_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("lo"), (at + 7200).alias("hi"))
    return joins.anti_union(spans.where("event_type = 'purchase'"), spans.where("event_type = 'click'"), ["user_id"], "lo", "hi", 7200.0).select("event_id", "user_id", "event_type")


@query("""
WITH r AS (SELECT p_brand, min(p_retailprice) AS lo, min(p_retailprice) + 40 AS hi FROM part GROUP BY 1)
SELECT r.p_brand, count(p.p_partkey) AS crossings FROM r LEFT JOIN part p ON p.p_retailprice BETWEEN r.lo AND r.hi GROUP BY 1""")
def crossing_count_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    ranges = parts.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), (F.min("p_retailprice") + 40).alias("hi"))
    hits = joins.points_in_ranges(parts.select("p_partkey", "p_retailprice"), "p_retailprice", ranges, "lo", "hi", 20.0).groupBy("p_brand").agg(F.count("*").alias("n"))
    return ranges.select("p_brand").join(hits, "p_brand", "left").select("p_brand", F.coalesce("n", F.lit(0)).alias("crossings"))


CENTRES = [900.0, 950.0, 1000.0, 1050.0, 1100.0]


@query("""
SELECT p_partkey, p_retailprice, CASE WHEN d <= 30 THEN i END AS nearest FROM (
  SELECT p_partkey, p_retailprice, i, abs(p_retailprice - (900 + 50 * i)) AS d FROM part, (SELECT CAST(range AS INTEGER) AS i FROM range(5)))
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, i) = 1""")
def nearest_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", CENTRES, 30.0)


BOX_SQL = "(SELECT p_partkey AS id, p_brand, p_size * 4.0 AS x0, p_retailprice - 900 AS y0, p_size * 4.0 + 40 AS x1, p_retailprice - 900 + 60 AS y1 FROM part)"


@query(f"""
WITH b AS {BOX_SQL}, p AS (SELECT a.id AS a_id, b.id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM b a JOIN b b ON a.p_brand = b.p_brand AND a.id < b.id)
SELECT a_id, b_id, round(i / (4800 - i), 6) AS iou FROM p WHERE i / (4800 - i) > 0.5""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size") * 4.0, F.col("p_retailprice") - 900
    all_boxes = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 60).alias("y1"))
    return boxes.id_pairs(all_boxes, ["p_brand"], "id", 0.5, 60.0).select("a_id", "b_id", F.round("iou", 6).alias("iou"))


@query("""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents)
SELECT doc_id, count(*) AS words, count(v.w) AS known, count(v.w) / count(*) >= 0.6 AS header FROM d LEFT JOIN v USING (w) GROUP BY 1""")
def vocabulary_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(words("text")).alias("word"))
    shares = joins.vocabulary_share(table(spark, sf_dir, "documents"), "doc_id", words("text"), vocabulary)
    return shares.withColumn("header", F.col("known") / F.col("words") >= 0.6)


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
p AS (SELECT a.word, b.word AS other, levenshtein(a.word, b.word) AS e FROM w a JOIN w b ON a.word <> b.word)
SELECT word, other AS nearest, CAST(e AS INTEGER) AS edits FROM p WHERE e <= 3 QUALIFY row_number() OVER (PARTITION BY word ORDER BY e, other) = 1""")
def nearest_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("word")).unionAll(parts.select(F.lower("p_type"))).distinct()
    return joins.nearest_word(words, words, 3)


@query("""
WITH t AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS votes, round(sum(value), 6) AS s FROM events GROUP BY 1, 2, 3)
SELECT user_id, day, event_type AS winner, votes FROM t QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY votes DESC, s DESC, event_type) = 1""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.vote(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"], "event_type", "value")


@query("""
SELECT doc_id, round((coalesce(quality * 0.28, 0) + coalesce((1 - toxic) * 0.24, 0) + coalesce(least(1.0, n_chars / 5000.0) * 0.18, 0))
  / (CASE WHEN quality IS NULL THEN 0 ELSE 0.28 END + CASE WHEN toxic IS NULL THEN 0 ELSE 0.24 END + CASE WHEN n_chars IS NULL THEN 0 ELSE 0.18 END), 6) AS confidence
FROM documents LEFT JOIN labels USING (doc_id)""")
def fuse_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = [(F.col("quality"), 0.28), (1 - F.col("toxic"), 0.24), (F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 0.18)]
    return both.select("doc_id", F.round(aggregates.weighted_mean(parts), 6).alias("confidence"))


@query("""
WITH o AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) AS tokens, sum(event_id)::BIGINT AS id_sum FROM o WHERE event_type <> 'view' AND event_type IS DISTINCT FROM p GROUP BY 1""")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows.collapse(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "view")
    return kept.groupBy("user_id").agg(F.count("*").alias("tokens"), F.sum("event_id").alias("id_sum"))


@query("""
SELECT s_nationkey, s_suppkey, count(*) AS near FROM supplier JOIN customer ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 150 GROUP BY 1, 2""")
def fuzzy_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal"), (F.col("s_acctbal") - 151).alias("lo"), (F.col("s_acctbal") + 151).alias("hi"))
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    pairs = joins.points_in_ranges(points, "c_acctbal", ranges, "lo", "hi", 300.0, ["nation"]).where(F.abs(F.col("c_acctbal") - F.col("s_acctbal")) <= 150)
    return pairs.groupBy(F.col("nation").alias("s_nationkey"), "s_suppkey").agg(F.count("*").alias("near"))


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang,
  len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", first("html", "<title>([^<]*)</title>").alias("title"), first("url", "^[a-z]+://([^/?#]+)").alias("host"), first("html", 'lang="([a-z]+)"').alias("lang"),
        F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"),
    )


@query("""
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1""")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k_sum"), F.count_distinct(k).alias("kinds"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\r]+') AS w FROM documents),
g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
v AS (SELECT regexp_extract_all(lower(text), '[^ \t\n\r]+') AS w FROM benchmark),
f AS (SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS n FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM v) GROUP BY 1, 2, 3)
SELECT doc_id, count(*) AS trigrams, count(n) AS known, round(sum(ln(coalesce(n, 1) / 1e6)), 4) AS score FROM g LEFT JOIN f USING (a, b, c) GROUP BY 1""")
def trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log score of every document's trigrams by their counts in the benchmark texts; unseen ones count once."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[^ \t\n\r]+"), F.lit(0))
    frequency = aggregates.trigrams(table(spark, sf_dir, "benchmark").select(words("text").alias("w"))).groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    return aggregates.trigram_score(table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w")), "doc_id", frequency)
