"""Queries on ordered rows: events of a user or day, lines of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.functions.numbers import half_up
from tablescribe.operators import series
from tablescribe.plans.boxes import BRAND, PAGE
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

SPANS = f"{PAGE}, p_partkey AS id, p_partkey * 37 % 2003 * 1.0D AS lo, p_partkey * 37 % 2003 * 1.0D + 9 + p_size % 5 AS hi"
SPANS_SQL = f"(SELECT {SPANS.replace('1.0D', '1.0::DOUBLE')} FROM part)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[c.strip() for c in SPANS.split(", ")])


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


DAYS_SQL = "(SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2)"
REACH_SQL = f"(SELECT *, max(hi) OVER (PARTITION BY page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {SPANS_SQL})"


@query(f"""
SELECT page, part, min(lo) AS lo, max(hi) AS hi, count(*) AS words FROM (
 SELECT page, lo, hi, sum(CASE WHEN reach IS NULL OR lo - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY lo, hi ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM {REACH_SQL}) GROUP BY 1, 2""")
def words_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = series.by_gap(_spans(spark, sf_dir), ["page"], "lo", "hi", 3.0)
    return parts.groupBy("page", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("words"))


@query(f"SELECT page, reach AS start, lo - reach AS gap FROM {REACH_SQL} WHERE lo > reach QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap DESC, start) = 1")
def widest_inner_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.widest_gap(_spans(spark, sf_dir), ["page"], "lo", "hi")


@query(f"""
WITH RECURSIVE o AS (SELECT page, p_retailprice AS v, row_number() OVER (PARTITION BY page ORDER BY p_retailprice, p_partkey) AS n FROM (SELECT *, {BRAND} FROM part)),
r AS (SELECT page, n, v, 0 AS cluster, v AS total, 1 AS members FROM o WHERE n = 1 UNION ALL
 SELECT o.page, o.n, o.v, CASE WHEN abs(o.v - r.total / r.members) <= 4 THEN r.cluster ELSE r.cluster + 1 END, CASE WHEN abs(o.v - r.total / r.members) <= 4 THEN r.total + o.v ELSE o.v END, CASE WHEN abs(o.v - r.total / r.members) <= 4 THEN r.members + 1 ELSE 1 END
 FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)
SELECT page, cluster, count(*) AS members, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1, 2""")
def running_mean_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(BRAND, "p_retailprice AS v")
    return series.running_cluster_bounds(rows, ["page"], "v", 4.0)


@query(None)
def lines_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(PAGE, "p_partkey AS id", "p_retailprice AS lo", "p_retailprice + 6 + p_size % 5 AS hi")
    return series.lines_by_overlap(rows, ["page"], "lo", "hi", "id", 0.5).select("page", "id", "line")


@query(f"""
WITH RECURSIVE o AS (SELECT page, p_retailprice AS v, row_number() OVER (PARTITION BY page ORDER BY p_retailprice) AS n FROM (SELECT *, {PAGE} FROM part)),
r AS (SELECT page, n, 0 AS k, v AS "at" FROM o WHERE n = 1 UNION ALL SELECT o.page, o.n, CASE WHEN o.v - r."at" < 3 THEN r.k ELSE r.k + 1 END, CASE WHEN o.v - r."at" < 3 THEN (r."at" + o.v) / 2 ELSE o.v END FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)
SELECT page, round(last("at" ORDER BY n), 6) AS "at" FROM r GROUP BY page, k""")
def collapsed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(PAGE, "p_retailprice AS at")
    return series.collapse_close(rows, ["page"], "at", 3.0).withColumn("at", F.round("at", 6))


@query("""
WITH o AS (SELECT l_orderkey, l_partkey AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity) AS n FROM lineitem),
s AS (SELECT a.l_orderkey, (a.y - b.y) / (a.x - b.x) AS s FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.n > a.n AND b.x > a.x),
u AS (SELECT l_orderkey, s AS slope FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s) = floor(count(*) OVER (PARTITION BY l_orderkey) / 2) + 1),
r AS (SELECT l_orderkey, slope, y - slope * x AS c FROM o JOIN u USING (l_orderkey))
SELECT l_orderkey, round(slope, 6) + 0 AS slope, round(c, 4) + 0 AS "offset" FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c) = floor(count(*) OVER (PARTITION BY l_orderkey) / 2) + 1""")
def theil_sen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey AS x", "l_quantity AS y")
    return series.theil_sen(points, ["l_orderkey"], "x", "y").select("l_orderkey", (F.round("slope", 6) + 0).alias("slope"), (F.round("offset", 4) + 0).alias("offset"))


@query("""
WITH o AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
i AS (SELECT *, n - lag(n) OVER (PARTITION BY user_id ORDER BY n) AS d FROM o WHERE value > 20),
r AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM i),
g AS (SELECT user_id, run, min(event_id) AS first, max(event_id) AS last, count(*) AS "rows" FROM r GROUP BY 1, 2)
SELECT user_id, first, last, "rows" FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "rows" DESC, first) = 1""")
def longest_run_with_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.longest_run(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 20, 1)


@query(f"""
WITH t AS (SELECT DISTINCT {PAGE}, p_size AS "at" FROM part), i AS (SELECT *, "at" - row_number() OVER (PARTITION BY page ORDER BY "at") AS g FROM t)
SELECT page, min("at") AS start, max("at") AS "end" FROM i GROUP BY page, g QUALIFY row_number() OVER (PARTITION BY page ORDER BY max("at") - min("at") DESC, min("at")) = 1""")
def first_title_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(PAGE, "p_size AS at")
    return series.first_block(rows, ["page"], "at")


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'refund' OR event_type = 'logout' OR event_type = 'signup' AS closes, event_type = 'purchase' AS item FROM events)
SELECT user_id, min(event_id) AS at FROM e WHERE closes AND EXISTS (SELECT 1 FROM e f WHERE f.user_id = e.user_id AND f.event_id < e.event_id AND f.item) GROUP BY 1""")
def first_close_after_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return series.first_after(table(spark, sf_dir, "events"), ["user_id"], "event_id", kind == "purchase", kind.isin("refund", "logout", "signup"))


@query(f"""
SELECT event_type, day AS at, "drop" FROM (SELECT event_type, day, lag(n) OVER (PARTITION BY event_type ORDER BY day) - n AS "drop" FROM {DAYS_SQL}) WHERE "drop" > 0
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY "drop" DESC, day) = 1""")
def worst_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.worst_drop(_days(spark, sf_dir), ["event_type"], "day", "n")


@query(f"SELECT event_type, day, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM {DAYS_SQL}")
def half_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.half_window_mean(_days(spark, sf_dir), ["event_type"], "day", "n", 7).select("event_type", "day", F.round("smooth", 6).alias("smooth"))


@query("""
WITH e AS (SELECT vec_id, [x::DOUBLE * 4 for x in embedding] AS v FROM embeddings), m AS (SELECT vec_id, [exp(x - list_max(v)) for x in v] AS p FROM e)
SELECT vec_id, round(p[1] / list_sum(p), 6) AS first, round(list_max(p) / list_sum(p), 6) AS greatest FROM m""")
def softmax_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform("embedding", lambda v: v.cast("double") * 4)
    shares = table(spark, sf_dir, "embeddings").select("vec_id", series.softmax(scores).alias("p"))
    return shares.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.array_max("p"), 6).alias("greatest"))


@query("""
WITH e AS (SELECT label, vec_id, [x::DOUBLE * 4 for x in embedding] AS v FROM embeddings), m AS (SELECT label, vec_id, [exp(x - list_max(v)) for x in v] AS p FROM e),
s AS (SELECT label, vec_id, list_max(p) / list_sum(p) AS p, list_position(p, list_max(p)) - 1 AS t FROM m), k AS (SELECT *, t <> 0 AND t IS DISTINCT FROM lag(t) OVER (PARTITION BY label ORDER BY vec_id) AS keep FROM s)
SELECT label, coalesce(string_agg(t::VARCHAR, ' ' ORDER BY vec_id) FILTER (keep), '') AS tokens, round(avg(p) FILTER (keep), 6) AS confidence FROM k GROUP BY 1""")
def decoded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double") * 4).alias("v"))
    return series.decode(steps, ["label"], "vec_id", "v", 0).withColumn("confidence", F.round("confidence", 6))


@query("SELECT l_suppkey, floor(1000 * median(l_quantity) + 0.5) / 1000 AS median FROM lineitem GROUP BY 1")
def interpolated_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(half_up(F.median("l_quantity"), 3).alias("median"))
